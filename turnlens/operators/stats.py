"""Small statistics as distributed jobs.

Kernel densities never cross the grid with the samples: samples are first
collapsed to (group, value, weight), and each distinct value is exploded only
onto the grid points within ``cut`` bandwidths of it (the kernel beyond that
is below 1e-30 of its peak, far under the 8-decimal rounding), then summed
with a partial aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

SQRT_2PI = math.sqrt(2.0 * math.pi)


def kde_grid(df: DataFrame, group: str, value: str, n_grid: int = 300, lo: float = 0.0,
             hi=None, bandwidth: float | None = None, kernel: str = "gaussian",
             cut: float = 12.0, min_n: int = 2) -> DataFrame:
    """Density per group on a shared grid lo..hi (``n_grid``
    points). Bandwidth: fixed, or Scott's sd·n^(−1/5) with ddof 1. Groups
    with n < ``min_n`` or zero spread are skipped. ``hi`` defaults to the max
    over all samples (a scalar subquery). Output: group, grid_i, x, density
    (x rounded to 4, density to 8)."""
    s = df.select(group, value).filter(F.col(value).isNotNull())
    params = (s.groupBy(group).agg(F.count(F.lit(1)).alias("__n"),
                                   F.stddev_samp(value).alias("__sd"))
              .filter((F.col("__n") >= min_n) & (F.col("__sd") > 0)))
    h = F.lit(float(bandwidth)) if bandwidth else F.col("__sd") * F.pow(F.col("__n"), -0.2)
    params = params.withColumn("__h", h)
    hi_c = F.lit(float(hi)) if hi is not None else s.select(F.max(value)).scalar()
    step = (hi_c - F.lit(lo)) / F.lit(n_grid - 1)
    pts = s.groupBy(group, value).agg(F.count(F.lit(1)).alias("__w"))
    j = pts.join(params, group, "inner")
    reach = F.lit(cut) * F.col("__h") if kernel == "gaussian" else F.col("__h")
    i_lo = F.greatest(F.lit(0), F.ceil((F.col(value) - reach - F.lit(lo)) / step).cast("int"))
    i_hi = F.least(F.lit(n_grid - 1), F.floor((F.col(value) + reach - F.lit(lo)) / step).cast("int"))
    j = j.filter(i_lo <= i_hi).withColumn("grid_i", F.explode(F.sequence(i_lo, i_hi)))
    x = F.lit(lo) + F.col("grid_i") * step
    d = x - F.col(value)
    if kernel == "gaussian":
        k = F.exp(-(d * d) / (F.lit(2.0) * F.col("__h") * F.col("__h"))) / F.lit(SQRT_2PI)
    elif kernel == "tophat":
        k = F.when(F.abs(d) < F.col("__h"), F.lit(0.5)).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown kernel {kernel}")
    contrib = j.groupBy(group, "grid_i").agg(F.sum(F.col("__w") * k).alias("__ksum"))
    spine = params.select(group, "__n", "__h").withColumn(
        "grid_i", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    out = spine.join(contrib, [group, "grid_i"], "left")
    dens = F.coalesce(F.col("__ksum"), F.lit(0.0)) / (F.col("__n") * F.col("__h"))
    return out.select(group, "grid_i", F.round(F.lit(lo) + F.col("grid_i") * step, 4).alias("x"),
                      F.round(dens, 8).alias("density"))


def kde_support_window(kde: DataFrame, group: str, x: str = "x", density: str = "density",
                       frac: float = 0.01) -> DataFrame:
    """X range where a group's density is at least ``frac`` of its peak."""
    peak = kde.groupBy(group).agg(F.max(density).alias("__peak"))
    return (kde.join(peak, group).filter(F.col(density) >= F.lit(frac) * F.col("__peak"))
            .groupBy(group).agg(F.min(x).alias("x_lo"), F.max(x).alias("x_hi")))


def goodman_critical(k: int, alpha: float = 0.05) -> float:
    """c = χ²₁(1 − α/k) = z(1 − α/(2k))²."""
    z = NormalDist().inv_cdf(1.0 - alpha / (2.0 * k))
    return z * z


def goodman_intervals(counts: DataFrame, cat: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Simultaneous multinomial intervals per category; ``star`` when
    the interval excludes 1/k. k comes from a count of the (small) category
    table; c is a driver-side scalar."""
    k = counts.count()
    c = goodman_critical(k, alpha)
    total = counts.select(F.sum(n)).scalar()
    p = F.col(n) / total
    nn = total
    root = F.sqrt(F.lit(c) * (F.lit(c) + F.lit(4.0) * F.col(n) * (F.lit(1.0) - p)))
    lo = (F.lit(2.0) * F.col(n) + F.lit(c) - root) / (F.lit(2.0) * (nn + F.lit(c)))
    hi = (F.lit(2.0) * F.col(n) + F.lit(c) + root) / (F.lit(2.0) * (nn + F.lit(c)))
    out = counts.select(cat, n, p.alias("share"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), lo)).alias("ci_lo"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), hi)).alias("ci_hi"))
    return out.withColumn("star", ((F.col("ci_lo") > 1.0 / k) | (F.col("ci_hi") < 1.0 / k)))


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of χ² (regularised upper incomplete gamma, series form)."""
    if x is None or dof is None or dof <= 0:
        return float("nan")
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    # lower regularised gamma by series, then 1 − P
    term = 1.0 / a
    total = term
    for i in range(1, 10_000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-17:
            break
    p_lower = total * math.exp(-z + a * math.log(z) - math.lgamma(a))
    return max(0.0, 1.0 - p_lower)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_chi2_sf(float(a), int(b)) for a, b in zip(x, dof)])


def chisq_gof_uniform(counts: DataFrame, n: str) -> DataFrame:
    """χ² goodness of fit of category counts against the uniform
    distribution: one row (statistic, dof, p_value)."""
    e = counts.select(F.sum(n)).scalar() / counts.select(F.count(F.lit(1))).scalar()
    stat = counts.agg(F.sum((F.col(n) - e) * (F.col(n) - e) / e).alias("statistic"),
                      (F.count(F.lit(1)) - 1).alias("dof"))
    return stat.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))


def binomial_bootstrap_ci(df: DataFrame, group: str, flag: str, replicates: int = 200,
                          seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Bootstrap percentile interval of a 0/1 rate per group.

    Resampling n rows of a 0/1 variable with replacement draws the number of
    ones from Binomial(n, p̂); so only (group, n, wins) is aggregated, and
    each (group, replicate) draws one binomial, seeded by (seed, group,
    replicate). Work is groups × replicates, independent of row count."""
    agg = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                F.sum(F.col(flag).cast("long")).alias("wins"))
    reps = agg.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    reps = reps.withColumn("__seed", F.xxhash64(F.lit(seed), F.col(group).cast("string"),
                                                F.col("rep")))

    @F.pandas_udf(T.DoubleType())
    def draw(n: pd.Series, wins: pd.Series, s: pd.Series) -> pd.Series:
        out = np.empty(len(n))
        for i, (nn, ww, ss) in enumerate(zip(n, wins, s)):
            rng = np.random.default_rng(int(ss) & 0xFFFFFFFFFFFF)
            out[i] = rng.binomial(int(nn), float(ww) / float(nn)) / float(nn) if nn else np.nan
        return pd.Series(out)

    rates = reps.withColumn("rate", draw("n", "wins", "__seed"))
    lo_q, hi_q = alpha / 2.0, 1.0 - alpha / 2.0
    return (rates.groupBy(group).agg(
        F.first("n").alias("n"), F.first("wins").alias("wins"),
        (F.first("wins") / F.first("n")).alias("rate"),
        F.percentile("rate", lo_q).alias("ci_lo"),
        F.percentile("rate", hi_q).alias("ci_hi")))


def correlations(df: DataFrame, target: str, columns: Sequence[str],
                 digits: int = 6) -> DataFrame:
    """Pearson correlation of ``target`` with each column, long form."""
    wide = df.agg(*[F.corr(target, c).alias(c) for c in columns])
    return (wide.unpivot([], list(columns), "column", "corr")
            .withColumn("corr", F.round("corr", digits)))


def composite_score(df: DataFrame, id_col: str, weights: dict[str, float],
                    out: str = "score") -> DataFrame:
    """Weighted column sum, scaled by its max, then shifted by the min
    of the scaled values (both scalar subqueries)."""
    raw = sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    d = df.select(id_col, raw.alias("__raw"))
    mx = d.select(F.max("__raw")).scalar()
    d = d.withColumn("__scaled", F.col("__raw") / mx)
    mn = d.select(F.min("__scaled")).scalar()
    return d.select(id_col, (F.col("__scaled") - mn).alias(out))


def iqr_outliers(df: DataFrame, group: str, value: str, id_col: str, show_n: int = 8) -> DataFrame:
    """Per group, IQR fences (q1 − 1.5·IQR, q3 + 1.5·IQR) and the rank of
    |x − median| (ties by id). Returns rows that are outliers or among the
    ``show_n`` nearest to the median, with ``show`` = outlier and rank ≤ n.
    The nearest rows come from a limited ranking (at most n rows per group
    leave each task); outliers are a filter; the two meet in a join against
    the n-per-group table, never in a full per-group sort."""
    from turnlens.operators.aggregate import grouped_exact_quantiles
    q = grouped_exact_quantiles(df, [group], value, [0.25, 0.5, 0.75], "__q")
    j = df.join(q, group).withColumn("__dist", F.abs(F.col(value) - F.col("__q_1")))
    iqr = F.col("__q_2") - F.col("__q_0")
    j = j.withColumn("is_outlier", (F.col(value) < F.col("__q_0") - 1.5 * iqr)
                     | (F.col(value) > F.col("__q_2") + 1.5 * iqr)).drop("__q_0", "__q_1", "__q_2")
    w = W.partitionBy(group).orderBy("__dist", id_col)
    near = j.withColumn("near_rank", F.row_number().over(w)).filter(F.col("near_rank") <= show_n)
    outliers = j.filter("is_outlier").join(near.select(id_col, "near_rank"), id_col, "left")
    out = near.filter(~F.col("is_outlier")).unionByName(outliers)
    return (out.withColumn("show", F.col("is_outlier") & F.col("near_rank").isNotNull())
            .drop("__dist"))
