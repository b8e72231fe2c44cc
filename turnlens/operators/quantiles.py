"""Exact quantiles by repeated histogram narrowing.

The value at a rank is searched for per key. While a key holds many distinct
values, a sketch of evenly spaced ranks gives every wanted rank a bracket of
neighbouring values; one aggregate counts the rows between and at the bracket
values; only the segment that holds the rank is kept, and the search goes on
inside it with the rank counted from the segment's start. A segment between
two bracket values holds a few thousandths of the key's rows however the
values are spread (one far outlier, powers of ten, heavy repeats: a heavy
value is a bracket value, hence a segment of its own), so two or three rounds
narrow billions of rows to a segment whose distinct values are counted in one
small window. Counts decide, not the sketch: if a rank lies outside its
bracket, the segment that does hold it is narrowed instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from turnlens.session import staged

# Distinct values of a key that one window may count.
FEW_VALUES = 1 << 16
# Evenly spaced ranks of the sketch, and its accuracy (rank error 1 / ACCURACY).
GRID, ACCURACY = 1000, 10_000


def _counted(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(group, i, v) of targets whose keys hold few distinct values."""
    counts = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    cum = counts.withColumn("upto", F.sum("c").over(upto))
    hit = (F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c"))
    return cum.join(targets, "k").filter(hit).select("group", "i", "v")


def brackets(rows: DataFrame, targets: DataFrame, grid: int = GRID) -> DataFrame:
    """(k, bounds): sorted distinct values around every wanted rank of k."""
    at = [i / grid for i in range(grid + 1)]
    sketch = rows.groupBy("k").agg(F.percentile_approx("v", at, ACCURACY).alias("s"),
                                   F.count(F.lit(1)).alias("n"))
    cell = F.floor(F.col("r") / F.col("n") * grid).cast("int")
    around = targets.join(sketch, "k").select(
        "k", F.array(F.get("s", F.greatest(cell - 1, F.lit(0))),
                     F.get("s", F.least(cell + 2, F.lit(grid)))).alias("b"))
    # at most two values a target
    return around.groupBy("k").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))).alias("bounds"))


def segmented(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(k, v, seg): 2m between the m-th bound and the next, 2m + 1 on a bound
    with m bounds below it. Segments follow the order of values."""
    below = F.size(F.filter("bounds", lambda b: b < F.col("v")))
    return rows.join(bounds, "k").select(
        "k", "v", (below * 2 + F.array_contains("bounds", F.col("v")).cast("int")).alias("seg"))


def select_ranks(rows: DataFrame, targets: DataFrame, few: int = FEW_VALUES,
                 grid: int = GRID) -> DataFrame:
    """(group, i, v): per target (k, group, i, r) the value at rank r (from 0)
    among the rows (k, v) of its key. No nulls in k and v."""
    found = None
    while True:
        wide = staged(rows.groupBy("k").agg(F.approx_count_distinct("v").alias("d"))
                      .filter(F.col("d") > few).select("k"), "wide-keys")
        if not wide.limit(1).count():
            last = _counted(rows, targets)
            return last if found is None else found.unionByName(last)
        here = _counted(rows.join(wide, "k", "left_anti"), targets.join(wide, "k", "left_anti"))
        found = here if found is None else found.unionByName(here)
        rows, targets = rows.join(wide, "k", "left_semi"), targets.join(wide, "k", "left_semi")
        marked = segmented(rows, staged(brackets(rows, targets, grid), "brackets"))
        before = W.partitionBy("k").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
        starts = marked.groupBy("k", "seg").agg(F.count(F.lit(1)).alias("c")).withColumn(
            "start", F.coalesce(F.sum("c").over(before), F.lit(0)))
        inside = (F.col("r") >= F.col("start")) & (F.col("r") < F.col("start") + F.col("c"))
        deeper = F.struct("k", "seg").alias("k")
        targets = staged(targets.join(starts, "k").filter(inside).select(
            deeper, "group", "i", (F.col("r") - F.col("start")).alias("r")), "targets")
        kept = marked.select(deeper, "v").join(targets.select("k").distinct(), "k", "left_semi")
        rows = staged(kept, "segments")     # a few thousandths of the rows, or repeats of one value


def grouped_exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                            probs: Sequence[float], out: str = "q",
                            few: int = FEW_VALUES, grid: int = GRID) -> DataFrame:
    """Exact continuous quantiles (linear interpolation, like ``percentile`` /
    ``quantile_cont``) per group; null values do not count, null group values
    form a group. Output: group + one column ``{out}_{i}`` per probability.
    ``group`` may be empty (one row)."""
    group = list(group)
    # a struct is never null, so null group values join like others; without
    # groups the key is 0 but no constant, or the joins on it would be products
    base = F.lit(0) if group else F.pmod(F.hash(F.col(value)), F.lit(1))
    key = F.struct(base.alias("_"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)])
    rows = df.select(key.alias("k"), F.col(value).alias("v")).filter(F.col("v").isNotNull())
    n = staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    asked = n.select("k", F.posexplode(F.array(*[
        F.lit(float(p)) * (F.col("n") - 1) for p in probs])).alias("j", "pos"))
    ranks = asked.select(F.col("k"), F.col("k").alias("group"), F.explode(F.array(
        F.struct((F.col("j") * 2).alias("i"), F.floor("pos").alias("r")),
        F.struct((F.col("j") * 2 + 1).alias("i"), F.ceil("pos").alias("r")))).alias("t"))
    at = select_ranks(rows, ranks.select("k", "group", "t.i", "t.r"), few, grid)
    picked = at.groupBy("group").agg(*[
        F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"v{i}") for i in range(2 * len(probs))])
    sizes = n.withColumnRenamed("k", "group")

    def between(j: int, p: float):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"v{2 * j}"), F.col(f"v{2 * j + 1}")
        return (lo + (hi - lo) * (pos - F.floor(pos))).alias(f"{out}_{j}")

    return picked.join(sizes, "group").select(
        *[F.col("group")[f"g{i}"].alias(c) for i, c in enumerate(group)],
        *[between(j, p) for j, p in enumerate(probs)])


def exact_quantile(df: DataFrame, value: str, p: float, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantile (quantile_cont) of a whole column as
    a one-row result ``q``. Equal values need no ``tiebreak``: rows are only
    counted."""
    return grouped_exact_quantiles(df, [], value, [p], "q").select(F.col("q_0").alias("q"))
