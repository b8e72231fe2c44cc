"""Pivot, unpivot and grid completion.

Pivots always take an explicit value list, so Spark runs no discovery job
and the output schema is fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pivot_count(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence,
                prefix: str = "n_") -> DataFrame:
    """Count per (keys, pivot value), zero-filled, BIGINT."""
    p = df.groupBy(*keys).pivot(pivot, list(values)).count()
    return p.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint")
                             .alias(f"{prefix}{v}") for v in values])


def pivot_agg(df: DataFrame, keys: Sequence[str], pivot: str, values: Sequence,
              measure: Column, prefix: str, fill=0) -> DataFrame:
    """One aggregate per pivot value, filled with ``fill``."""
    p = df.groupBy(*keys).pivot(pivot, list(values)).agg(measure)
    cols = []
    for v in values:
        c = F.col(f"`{v}`")
        cols.append((F.coalesce(c, F.lit(fill)) if fill is not None else c).alias(f"{prefix}{v}"))
    return p.select(*keys, *cols)


def unpivot(df: DataFrame, ids: Sequence[str], columns: dict[str, str],
            var: str, val: str) -> DataFrame:
    """Wide → long. ``columns`` maps source column → label in ``var``."""
    renamed = df.select(*ids, *[F.col(c).alias(lbl) for c, lbl in columns.items()])
    return renamed.unpivot(list(ids), list(columns.values()), var, val)


def complete_grid(df: DataFrame, row_key: str, col_key: str, col_values: Sequence,
                  measure: Column, out: str, fill=0) -> DataFrame:
    """Every (row_key, col value) pair, missing ones filled.

    Built as pivot (explicit values) → fill → unpivot, so the full grid is
    produced without a cross join; rows come only from keys present in df.
    """
    wide = pivot_agg(df, [row_key], col_key, col_values, measure, "__g_", fill)
    long = wide.unpivot([row_key], [f"__g_{v}" for v in col_values], col_key, out)
    return long.withColumn(col_key, F.regexp_replace(col_key, "^__g_", ""))


def owner_flag_pivot(df: DataFrame, index: Sequence[str], flag: str, value: str,
                     count: str, value_default=0.0, count_default=0) -> DataFrame:
    """Split a 0/1 flag into value_0/value_1 and n_0/n_1 columns with
    defaults."""
    p = df.groupBy(*index).pivot(flag, [0, 1]).agg(F.first(value).alias("v"),
                                                  F.first(count).alias("n"))
    return p.select(*index,
                    F.coalesce(F.col("0_v"), F.lit(value_default)).alias(f"{value}_0"),
                    F.coalesce(F.col("1_v"), F.lit(value_default)).alias(f"{value}_1"),
                    F.coalesce(F.col("0_n"), F.lit(count_default)).alias(f"{count}_0"),
                    F.coalesce(F.col("1_n"), F.lit(count_default)).alias(f"{count}_1"))
