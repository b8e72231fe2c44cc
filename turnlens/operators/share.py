"""Shares of totals.

Totals are computed by a partial aggregate and joined back on the group
keys rather than with ``sum().over(partitionBy(group))``: the aggregate
combines map-side, and the join of a large side with a per-group table is
split by AQE's skew handling if one group is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


def share_within(df: DataFrame, group: Sequence[str], value: str,
                 out: str = "share", total_out: str | None = None) -> DataFrame:
    """Value / sum(value) over rows of the same group."""
    group = list(group)
    tot = df.groupBy(*group).agg(F.sum(value).alias("__tot"))
    j = df.join(tot, group, "inner") if group else df.withColumn(
        "__tot", df.select(F.sum(value)).scalar())
    j = j.withColumn(out, F.try_divide(F.col(value), F.nullif(F.col("__tot"), F.lit(0))))
    if total_out:
        return j.withColumnRenamed("__tot", total_out)
    return j.drop("__tot")


def category_share(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Share of a grand total; the total is a scalar subquery."""
    total = df.select(F.sum(value)).scalar()
    return df.withColumn(out, F.col(value) / total)


def cumulative_share(summary: DataFrame, order: Sequence[str], share: str,
                     cum_out: str = "cum_share", start_out: str = "start") -> DataFrame:
    """W06 on a summary table (one row per category, so the global window
    holds as many rows as there are categories): running share and its
    lagged start (0 for the first)."""
    w = W.orderBy(*order)
    return (summary.withColumn(cum_out, F.sum(share).over(w.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn(start_out, F.lag(cum_out, 1, 0.0).over(w)))
