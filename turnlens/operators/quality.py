"""Data-quality operators (Q01–Q07): audits are tables, not exceptions, so
a bad file or key is reported while the rest of the job completes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def parse_audit(lines: DataFrame, file_key: Sequence[str], line_no: str, line: str,
                is_bad: Column) -> DataFrame:
    """Q01: per file, line counts, bad-line count, and the first bad line
    (position and text) — one partial aggregate, no per-file collect."""
    d = lines.withColumn("__bad", is_bad)
    return d.groupBy(*file_key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("__bad").alias("n_bad"),
        F.min(F.when(F.col("__bad"), F.col(line_no))).alias("first_bad_line_no"),
        F.min_by(F.col(line), F.when(F.col("__bad"), F.col(line_no))).alias("first_bad_line"))


def unknown_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Q02: distinct keys of the facts missing from the dimension."""
    return facts.select(key).distinct().join(dimension.select(key), key, "left_anti")


def drop_left_censored(df: DataFrame, entity: Sequence[str], turn: str,
                       max_first_turn: int) -> DataFrame:
    """Q03: keep entities whose first logged turn is at most ``max_first_turn``."""
    ok = df.groupBy(*entity).agg(F.min(turn).alias("__t0")).filter(
        F.col("__t0") <= max_first_turn)
    return df.join(ok.select(*entity), list(entity), "left_semi")


def roster_check(df: DataFrame, group: str, member: str, expected_count: int,
                 expected_members: Sequence[str] | None = None) -> DataFrame:
    """Q04: groups whose distinct member count differs from the expected
    count, or that miss expected members (set difference, bounded by the
    roster size)."""
    g = df.groupBy(group).agg(F.countDistinct(member).alias("n_members"),
                              F.array_sort(F.collect_set(member)).alias("members"))
    missing = (F.array_except(F.array(*[F.lit(m) for m in expected_members]), F.col("members"))
               if expected_members else F.array().cast("array<string>"))
    g = g.withColumn("missing", missing)
    return g.filter((F.col("n_members") != expected_count) | (F.size("missing") > 0))


def degenerate_entities(df: DataFrame, entity: Sequence[str], dim: str) -> DataFrame:
    """Q05: entities that only ever show one value of ``dim`` (e.g. one era)."""
    return (df.groupBy(*entity).agg(F.countDistinct(dim).alias("n_distinct"))
            .filter(F.col("n_distinct") == 1).select(*entity))


def discrepancy_report(a: DataFrame, b: DataFrame, key: Sequence[str], a_col: str,
                       b_col: str) -> DataFrame:
    """Q06: keys where two counts disagree (missing = 0)."""
    j = a.join(b, list(key), "full")
    j = j.withColumn(a_col, F.coalesce(a_col, F.lit(0))).withColumn(b_col, F.coalesce(b_col, F.lit(0)))
    return j.withColumn("difference", F.col(a_col) - F.col(b_col)).filter(F.col("difference") != 0)


class RowCountMismatch(AssertionError):
    pass


def assert_row_count(df: DataFrame, expected: int, what: str = "frame") -> DataFrame:
    """Q07: raise when a (small, final) result does not have the expected
    row count; returns the frame for chaining."""
    n = df.count()
    if n != expected:
        raise RowCountMismatch(f"{what}: expected {expected} rows, got {n}")
    return df


def require_rows(got: int, expected: int | None, what: str) -> None:
    """Q07 for counts that were taken while writing."""
    if expected is not None and got != expected:
        raise RowCountMismatch(f"{what}: expected {expected} rows, got {got}")
