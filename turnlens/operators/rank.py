"""First / latest / top-k per group, tie-aware places, argmax flags (§2.6).

Where a result is one row per group, a ``groupBy`` with ``min_by``/``max_by``
is used instead of a ranking window: it aggregates map-side, so a key that
holds a third of all rows is folded in every input task before the shuffle.
Top-k windows with ``row_number() <= k`` get Spark's partial WindowGroupLimit
before the exchange, so each task ships at most k rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnlens.operators.ordered import global_row_number


def _struct(cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    cols: Sequence[str], prefix: str = "first_") -> DataFrame:
    """The row with the smallest ``order`` per key (no ties:
    ``order`` must end with a unique tiebreak)."""
    picked = F.min_by(_struct(cols), _struct(order)).alias("__p")
    out = df.groupBy(*keys).agg(picked)
    return out.select(*keys, *[F.col("__p")[c].alias(prefix + c) for c in cols])


def last_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   cols: Sequence[str], prefix: str = "last_") -> DataFrame:
    """Latest row per key (no ties)."""
    picked = F.max_by(_struct(cols), _struct(order)).alias("__p")
    out = df.groupBy(*keys).agg(picked)
    return out.select(*keys, *[F.col("__p")[c].alias(prefix + c) for c in cols])


def rows_at_group_extreme(df: DataFrame, keys: Sequence[str], value: str,
                          kind: str = "max") -> DataFrame:
    """Join a frame to its own per-key max (or min); ties are kept."""
    agg = F.max(value) if kind == "max" else F.min(value)
    ext = df.groupBy(*keys).agg(agg.alias("__ext"))
    return (df.join(ext, list(keys), "inner")
            .filter(F.col(value) == F.col("__ext")).drop("__ext"))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    k: int, rank_col: str = "rank") -> DataFrame:
    """At most k rows per key by ``order`` (give a unique tiebreak)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def flag_group_argmax(df: DataFrame, keys: Sequence[str], score: str, id_col: str,
                      out: str = "is_top") -> DataFrame:
    """Flag the one row per key with the highest score (smallest id on
    ties). The winner is found by a partial aggregate and joined back."""
    best = df.groupBy(*keys).agg(
        F.min_by(F.col(id_col), F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("score"),
                                         F.col(id_col).alias("id"))).alias("__best"))
    return (df.join(best, list(keys), "left")
            .withColumn(out, (F.col(id_col) == F.col("__best")).cast("int"))
            .drop("__best"))


def finishing_place(df: DataFrame, game: str, entity: str, score: str,
                    dead: str, death_key: str, out: str = "place") -> DataFrame:
    """Places inside each game. Living entities are ordered by score
    descending (place = position); dead ones fill the bottom by death order
    (earliest death = last place). Entities sharing (dead, death key or
    score) get the average of their places. A game holds a bounded number of
    players, so the per-game window is small."""
    alive_w = W.partitionBy(game, dead).orderBy(F.col(score).desc(), F.col(entity))
    dead_w = W.partitionBy(game, dead).orderBy(F.col(death_key).asc(), F.col(entity))
    n_w = W.partitionBy(game)
    pos = F.when(F.col(dead), F.row_number().over(dead_w)).otherwise(F.row_number().over(alive_w))
    d = df.withColumn("__n", F.count(F.lit(1)).over(n_w)).withColumn("__pos", pos)
    d = d.withColumn("__raw", F.when(F.col(dead), F.col("__n") - F.col("__pos") + 1)
                     .otherwise(F.col("__pos")))
    tie = F.when(F.col(dead), F.col(death_key).cast("double")).otherwise(
        F.col(score).cast("double"))
    d = d.withColumn("__tie", tie)
    return (d.withColumn(out, F.avg("__raw").over(W.partitionBy(game, dead, "__tie")))
            .drop("__n", "__pos", "__raw", "__tie"))


def rank_two_versions(a: DataFrame, b: DataFrame, key: str, value: str,
                      names: tuple[str, str] = ("rank_a", "rank_b"),
                      delta: str = "rank_delta") -> DataFrame:
    """W15 + J17: rank each version by value descending (key breaks ties),
    full outer join on key, rank delta = a − b."""
    ra = global_row_number(a.select(key, value), [F.col(value).desc(), F.col(key)], names[0])
    rb = global_row_number(b.select(key, value), [F.col(value).desc(), F.col(key)], names[1])
    j = ra.select(key, names[0]).join(rb.select(key, names[1]), key, "full")
    return j.withColumn(delta, F.col(names[0]) - F.col(names[1]))


def display_rank(df: DataFrame, order: Sequence[Column], out: str = "display_rank") -> DataFrame:
    """1-based rank after a stable sort (order must be total)."""
    return global_row_number(df, order, out)
