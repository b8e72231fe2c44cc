"""Grouped measures (§2.5): category stats, true-denominator means,
ordered string aggregation, set signatures, histograms, quantiles.

Lists are only ever collected over a bounded domain (the distinct items of
a key, e.g. its event types), never over a key's raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnlens.operators.quantiles import exact_quantile, grouped_exact_quantiles  # noqa: F401


def group_stats(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6,
                prefix: str = "") -> DataFrame:
    """N, mean, sample stddev, median per group (the median is
    the distributed exact quantile, so a hot group is not one buffer)."""
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    moments = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}n"),
        r(F.avg(value)).alias(f"{prefix}mean"),
        r(F.stddev_samp(value)).alias(f"{prefix}sd"))
    med = grouped_exact_quantiles(df, keys, value, [0.5], "__med")
    return moments.join(med, list(keys), "left").select(
        *moments.columns, r(F.col("__med_0")).alias(f"{prefix}median"))


def true_denominator_mean(facts: DataFrame, spine: DataFrame, entity: Sequence[str],
                          slice_keys: Sequence[str], turn: str, value: str) -> DataFrame:
    """Per (entity, slice): total / number of distinct spine
    turns of that entity in the slice (turns without facts count as 0), then
    the mean over entities and their count N per slice."""
    entity, slice_keys = list(entity), list(slice_keys)
    num = facts.groupBy(*entity, *slice_keys).agg(F.sum(value).alias("__tot"))
    den = spine.groupBy(*entity, *[k for k in slice_keys if k in spine.columns]).agg(
        F.countDistinct(turn).alias("__turns"))
    on = entity + [k for k in slice_keys if k in spine.columns]
    per = num.join(den, on, "inner").withColumn("__per_turn", F.col("__tot") / F.col("__turns"))
    return per.groupBy(*slice_keys).agg(F.avg("__per_turn").alias("mean_per_turn"),
                                        F.count(F.lit(1)).alias("n_entities"))


def ordered_string_agg(df: DataFrame, keys: Sequence[str], item: str, order: Sequence[str],
                       sep: str = "|", out: str = "path") -> DataFrame:
    """Distinct items per key in order of first occurrence, joined.
    Rows collapse to (key, item, first position) first, so the collected
    list is bounded by the number of distinct items."""
    first = df.groupBy(*keys, item).agg(F.min(F.struct(*order)).alias("__first"))
    return first.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__first", item))),
                                 lambda s: s[item]), sep).alias(out))


def set_signature(df: DataFrame, keys: Sequence[str], item: str, sep: str = "|",
                  out: str = "signature") -> DataFrame:
    """Sorted distinct set of items per key, as text."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(item)), sep).alias(out))


def histogram(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between each group's min and max (max falls in
    the last bin); count per (group, bin)."""
    rng = df.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    j = df.join(rng, group)
    width = F.col("__hi") - F.col("__lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(value) - F.col("__lo")) / width * bins), F.lit(bins - 1)) + 1)
    return (j.withColumn("bin", b.cast("int")).groupBy(group, "bin")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.min("__lo").alias("range_lo"), F.min("__hi").alias("range_hi")))


def five_number(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Min, q1, median, q3, max (continuous quantiles) per group."""
    names = ["min", "q1", "median", "q3", "max"]
    g = grouped_exact_quantiles(df, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0], "__q")
    return g.select(*keys, *[F.round(F.col(f"__q_{i}"), digits).alias(f"{value}_{nm}")
                             for i, nm in enumerate(names)])


def count_if_crosstab(df: DataFrame, keys: Sequence[str], cat: str, values: Sequence,
                      prefix: str = "n_", rest: str = "n_rest") -> DataFrame:
    """count_if per listed value, plus the remainder."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(F.col(cat) == F.lit(v)).alias(f"{prefix}{v}") for v in values]
    g = df.groupBy(*keys).agg(*aggs)
    return g.withColumn(rest, F.col("n") - sum((F.col(f"{prefix}{v}") for v in values),
                                               F.lit(0)))


def presence_list(df: DataFrame, keys: Sequence[str], item: str, measures: Sequence[str],
                  out: str = "items") -> DataFrame:
    """Sorted distinct items with any nonzero measure."""
    nz = F.lit(False)
    for m in measures:
        nz = nz | (F.coalesce(F.col(m), F.lit(0)) != 0)
    return df.filter(nz).groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias(out))


def distinct_ratio(df: DataFrame, keys: Sequence[str], numerator: Column, distinct_of: str,
                   out: str = "per_distinct") -> DataFrame:
    """Total / number of distinct ids."""
    return df.groupBy(*keys).agg((F.sum(numerator) / F.countDistinct(distinct_of)).alias(out))


def milestone_after(picks: DataFrame, reached: DataFrame, on: Sequence[str], item: str,
                    turn: str) -> DataFrame:
    """Per picked item: picks, the share whose owner reached the
    milestone (a row of ``reached``), and the mean turn of those that did."""
    j = picks.join(reached.select(*on, F.col(turn).alias("__t"), F.lit(1.0).alias("__hit")), list(on), "left")
    return j.groupBy(item).agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.coalesce("__hit", F.lit(0.0))).alias("share"),
                               F.avg("__t").alias(f"mean_{turn}"))
