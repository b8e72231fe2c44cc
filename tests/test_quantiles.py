"""Quantiles by histogram narrowing against Spark's own ``percentile``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from turnlens.operators import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def spread(kind, n, rng):
    if kind == "outlier":           # all but one value in a millionth of the range
        return [rng.random() for _ in range(n - 1)] + [1e12]
    if kind == "powers":
        return [10.0 ** rng.uniform(-200, 200) for _ in range(n)]
    if kind == "heavy":             # two values hold most rows, the rest lie between
        return [0.0] * (n // 2) + [1.0] * (n // 2 - n // 10) + [rng.random() for _ in range(n // 10)]
    return [rng.gauss(0, 1) for _ in range(n)]


def frame(spark, kinds, n):
    rng = random.Random(5)
    rows = [(kind, v) for kind in kinds for v in spread(kind, n, rng)] + [("empty", None), (None, 3.0), (None, 5.0)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize("few", [1 << 16, 50])
def test_same_as_percentile_on_skewed_values(spark, few):
    df = frame(spark, ["outlier", "powers", "heavy", "normal"], 4000).cache()
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", PROBS).alias("q")).collect() if r.q}
    got = {r.g: [r[f"q_{i}"] for i in range(len(PROBS))]
           for r in quantiles.grouped_exact_quantiles(df, ["g"], "v", PROBS, few=few, grid=20).collect()}
    assert set(got) == set(want) == {"outlier", "powers", "heavy", "normal", None}
    for g, q in want.items():
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[g], q, strict=True)), g


def test_whole_column_and_integers(spark):
    df = spark.range(10_001).select((F.col("id") * F.col("id") % 7919).alias("v"), F.lit("x").alias("k"))
    want = df.agg(F.percentile("v", 0.3)).first()[0]
    assert quantiles.exact_quantile(df, "v", 0.3).first().q == want
    assert quantiles.grouped_exact_quantiles(df, [], "v", [0.3], few=30, grid=10).first().q_0 == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.grouped_exact_quantiles(df, ["g"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("kind", ["outlier", "powers", "heavy", "normal"])
def test_no_wide_segment(spark, kind):
    """No segment between two bracket values that is searched further holds
    over 1 % of the rows, one outlier or not."""
    n = 20_000
    rows = frame(spark, [kind], n).filter(F.col("g") == kind).select(F.struct("g").alias("k"), "v").cache()
    ranks = [0, n // 100, n // 4, n // 2, n - 2, n - 1]
    targets = rows.select("k").distinct().select("k", F.col("k").alias("group"),
                                                 F.posexplode(F.array(*map(F.lit, ranks))).alias("i", "r"))
    counts = quantiles.segmented(rows, quantiles.brackets(rows, targets)).groupBy("seg").count() \
        .orderBy("seg").collect()
    start, checked = 0, 0
    for r in counts:
        hit = [x for x in ranks if start <= x < start + r["count"]]
        assert not hit or r.seg % 2 or r["count"] <= n // 100
        checked += len(hit)
        start += r["count"]
    assert checked == len(ranks) and start == n
