"""Ordered scans that stay parallel when one key holds a large share of rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task. Running sums, counts, maxima, last-non-null, lag and lead are all
associative scans, so they can be split: each (key, chunk) scans its rows
locally, a small per-(key, chunk) summary is scanned per key to give the state
carried in from earlier chunks, and one equi-join on (key, chunk) combines the
two. ``chunk`` is any expression that does not decrease along the order within
a key (the day of a timestamp, a turn bucket, ...). The summary has one row per
(key, chunk), so its window is bounded by the number of chunks, not by rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from turnlens.session import scratch_dir

_UNB = W.unboundedPreceding
_CHUNK = "__chunk"


def _tmp(kind: str, name: str) -> str:
    return f"__{kind}_{name}"


def _sentinel(dtype: T.DataType) -> Column:
    """A non-null stand-in value of the same type (paired with an is-null
    flag, so it can never be confused with a real value)."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.DateType):
        return F.lit("0001-01-01").cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("0001-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    return F.lit(None).cast(dtype)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 chunk: Column, *, row_number: str | None = None,
                 sums: Mapping[str, Column] | None = None,
                 maxes: Mapping[str, Column] | None = None,
                 lasts: Mapping[str, Column] | None = None,
                 lags: Mapping[str, Column] | None = None,
                 leads: Mapping[str, Column] | None = None) -> DataFrame:
    """Add running columns per ``keys`` in ``order`` (ascending, unique).

    row_number: 1-based position. sums/maxes: inclusive running sum/max.
    lasts: last non-null value so far, current row included. lags/leads:
    value on the previous/next row of the key (null at the ends).

    Plan: all rows are shuffled once, on (keys, chunk), for the local
    window. The per-chunk summary is a map-side partial aggregate of the same
    input (only one row per (key, chunk) crosses the network), scanned per
    key in a window bounded by the number of chunks, and joined back on
    (keys, chunk). Keys and chunk enter the plan as non-null (value-or-
    sentinel, is-null flag) pairs, so null keys form their own groups and the
    join reuses the window's partitioning: only the small summary side moves.
    """
    sums, maxes, lasts = dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    lags, leads = dict(lags or {}), dict(leads or {})
    keys, order = list(keys), list(order)
    d = df.withColumn(_CHUNK, chunk)
    surrogate, flags = [], []
    for i, c in enumerate(keys + [_CHUNK]):
        v, n = f"__sk{i}", f"__sn{i}"
        d = d.withColumn(n, F.col(c).isNull()).withColumn(
            v, F.coalesce(F.col(c), _sentinel(d.schema[c].dataType)))
        surrogate.append(v)
        flags.append(n)
    part = surrogate + flags
    key_part = surrogate[:-1] + flags[:-1]
    chunk_order = [F.col(flags[-1]).desc(), F.col(surrogate[-1])]   # null chunk first
    for kind, m in (("s", sums), ("m", maxes), ("l", lasts), ("g", lags), ("d", leads)):
        for name, expr in m.items():
            d = d.withColumn(_tmp(kind, name), expr)

    # 1. local scan inside each (key, chunk): the only full shuffle
    wl = W.partitionBy(*part).orderBy(*order)
    wrun = wl.rowsBetween(_UNB, 0)
    loc_cols = [F.row_number().over(wl).alias("__rn_loc")]
    loc_cols += [F.sum(_tmp("s", n)).over(wrun).alias(_tmp("s", n) + "_loc") for n in sums]
    loc_cols += [F.max(_tmp("m", n)).over(wrun).alias(_tmp("m", n) + "_loc") for n in maxes]
    loc_cols += [F.last(_tmp("l", n), ignorenulls=True).over(wrun).alias(_tmp("l", n) + "_loc")
                 for n in lasts]
    loc_cols += [F.lag(_tmp("g", n), 1).over(wl).alias(_tmp("g", n) + "_loc") for n in lags]
    loc_cols += [F.lead(_tmp("d", n), 1).over(wl).alias(_tmp("d", n) + "_loc") for n in leads]
    if leads:
        loc_cols.append(F.lead(F.lit(True), 1).over(wl).alias("__has_next"))
    loc = d.select("*", *loc_cols)

    # 2. one summary row per (key, chunk) by a map-side partial aggregate
    #    (only summary rows cross the network), scanned per key over chunks
    okey = F.struct(*[F.col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(_tmp("s", n)).alias(_tmp("s", n)) for n in sums]
    aggs += [F.max(_tmp("m", n)).alias(_tmp("m", n)) for n in maxes]
    aggs += [F.max_by(_tmp("l", n), F.when(F.col(_tmp("l", n)).isNotNull(), okey))
             .alias(_tmp("l", n)) for n in lasts]
    aggs += [F.max_by(_tmp("g", n), okey).alias(_tmp("g", n)) for n in lags]
    aggs += [F.min_by(_tmp("d", n), okey).alias(_tmp("d", n)) for n in leads]
    summary = d.groupBy(*part).agg(*aggs)
    wc = W.partitionBy(*key_part).orderBy(*chunk_order)
    wprev = wc.rowsBetween(_UNB, -1)
    carry_cols = [F.sum("__n").over(wprev).alias("__n_c")]
    carry_cols += [F.sum(_tmp("s", n)).over(wprev).alias(_tmp("s", n) + "_c") for n in sums]
    carry_cols += [F.max(_tmp("m", n)).over(wprev).alias(_tmp("m", n) + "_c") for n in maxes]
    carry_cols += [F.last(_tmp("l", n), ignorenulls=True).over(wprev).alias(_tmp("l", n) + "_c")
                   for n in lasts]
    carry_cols += [F.lag(_tmp("g", n), 1).over(wc).alias(_tmp("g", n) + "_c") for n in lags]
    carry_cols += [F.lead(_tmp("d", n), 1).over(wc).alias(_tmp("d", n) + "_c") for n in leads]
    carry = summary.select(*part, *carry_cols)

    # 3. combine on the non-null surrogates (the left side is already
    #    partitioned by them)
    out = loc.join(carry, part, "inner")
    final = {}
    if row_number:
        final[row_number] = F.coalesce(F.col("__n_c"), F.lit(0)) + F.col("__rn_loc")
    for n in sums:
        a, b = F.col(_tmp("s", n) + "_loc"), F.col(_tmp("s", n) + "_c")
        final[n] = F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    for n in maxes:
        final[n] = F.greatest(F.col(_tmp("m", n) + "_loc"), F.col(_tmp("m", n) + "_c"))
    for n in lasts:
        final[n] = F.coalesce(F.col(_tmp("l", n) + "_loc"), F.col(_tmp("l", n) + "_c"))
    for n in lags:
        final[n] = F.when(F.col("__rn_loc") == 1, F.col(_tmp("g", n) + "_c")).otherwise(
            F.col(_tmp("g", n) + "_loc"))
    for n in leads:
        final[n] = F.when(F.col("__has_next").isNull(), F.col(_tmp("d", n) + "_c")).otherwise(
            F.col(_tmp("d", n) + "_loc"))
    out = out.withColumns(final)
    return out.select(*df.columns, *final.keys())


def global_row_number(df: DataFrame, order: Sequence[Column | str], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based position in a total order without a single-partition window.

    The rows are range-partitioned on the order, numbered inside each
    partition and written to the shared scratch folder in one job; offsets are
    then taken from the written rows. (Evaluating the partitioning twice would
    sample other boundaries: numbers would repeat and be missing.) The offset
    table has one row per partition, so broadcasting it is bounded by the
    partition count. ``order`` must be a total order (add a unique tiebreak
    column).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__idx", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("__pid").cast("long"), 33)))
    path = scratch_dir(spark, "row-number")
    ranged.write.parquet(path)
    placed = spark.read.schema(ranged.schema).parquet(path)
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__cnt").over(W.orderBy("__pid").rowsBetween(_UNB, -1)),
                   F.lit(0)).alias("__off"))
    return (placed.join(F.broadcast(offsets), "__pid")
            .withColumn(out, F.col("__off") + F.col("__idx") + 1)
            .drop("__pid", "__idx", "__off"))


def explode_interval(df: DataFrame, start: str, end: str, out: str = "turn") -> DataFrame:
    """One row per integer point of the closed interval [start, end]."""
    return df.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end))))


def explode_day_interval(df: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """W19 for dates: one row per day of [start, end]."""
    return df.withColumn(out, F.explode(F.sequence(F.to_date(start), F.to_date(end),
                                                   F.expr("INTERVAL 1 DAY"))))


def dense_spine(keys_df: DataFrame, lo: int, hi: int, out: str = "turn") -> DataFrame:
    """Every distinct key row crossed with the integers lo..hi, built by
    exploding a sequence per key (no join)."""
    return keys_df.distinct().withColumn(out, F.explode(F.sequence(F.lit(lo), F.lit(hi))))


def spine_running_total(facts: DataFrame, keys: Sequence[str], turn: str, value: str,
                        lo: int, hi: int, out_value: str = "value",
                        out_total: str = "running_total") -> DataFrame:
    """W05 + J07 + P08: dense (keys, turn=lo..hi) spine for every key that has
    facts; facts outside lo..hi never enter; missing turns are 0; running
    inclusive sum per key. Each key's window holds hi - lo + 1 rows."""
    keys = list(keys)
    inside = facts.filter(F.col(turn).between(lo, hi))
    per_turn = inside.groupBy(*keys, turn).agg(F.sum(value).alias(out_value))
    spine = dense_spine(facts.select(*keys), lo, hi, turn)
    filled = spine.join(per_turn, keys + [turn], "left").na.fill(0, [out_value])
    w = W.partitionBy(*keys).orderBy(turn).rowsBetween(_UNB, 0)
    return filled.withColumn(out_total, F.sum(out_value).over(w))


def last_per_spine_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key with the max value (dedupe a spine that holds a
    key twice)."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
               left_on: str, right_on: str, left_tiebreak: str, right_tiebreak: str,
               carry: Sequence[str], chunk_of=None) -> DataFrame:
    """J06 as-of join: each left row gets the columns ``carry`` of the latest
    right row with equal ``keys`` and ``right_on`` <= the left row's ``left_on``
    (latest by (right_on, right_tiebreak)); null when there is none.

    Both sides are unioned into one ordered stream per key; right rows sort
    before left rows on equal time, and a split ordered scan carries the last
    right payload forward. No range join, no per-key fan-out.
    """
    keys, carry = list(keys), list(carry)
    chunk_of = chunk_of or (lambda c: F.to_date(c))
    left_t = left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType
    right_t = right.select(F.struct(*carry).alias("s")).schema["s"].dataType
    l2 = left.select(*keys, F.col(left_on).alias("__t"), F.lit(1).alias("__side"),
                     F.lit(None).cast(right.schema[right_tiebreak].dataType).alias("__rtb"),
                     F.col(left_tiebreak).alias("__ltb"),
                     F.struct(*left.columns).alias("__left"),
                     F.lit(None).cast(right_t).alias("__right"))
    r2 = right.select(*keys, F.col(right_on).alias("__t"), F.lit(0).alias("__side"),
                      F.col(right_tiebreak).alias("__rtb"),
                      F.lit(None).cast(left.schema[left_tiebreak].dataType).alias("__ltb"),
                      F.lit(None).cast(left_t).alias("__left"),
                      F.struct(*carry).alias("__right"))
    both = l2.unionByName(r2)
    scanned = ordered_scan(both, keys, ["__t", "__side", "__rtb", "__ltb"],
                           chunk_of(F.col("__t")), lasts={"__asof": F.col("__right")})
    res = scanned.filter(F.col("__side") == 1)
    return res.select("__left.*", *[F.col("__asof")[c].alias(c) for c in carry])
