"""Helpers shared by the operators of this package.

Row keys. ``doc_id`` may be null or repeated, so operators that must join a
result back to its row use the pair (``_rf``, ``_rr``): a hash of the file the
row was read from and its position there. Both come from the scan itself and
stay the same when a lost task is run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlens.session import scratch_dir

ROW_KEY = ["_rf", "_rr"]

#: White space of the word definition ``[^\x20\x09-\x0D]+`` as a regex class.
SPACE = r"[\x20\x09-\x0D]"


#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long rows: keep what one Arrow batch holds small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(name, str(BATCH_ROWS))


_kept: list[Callable[[], None]] = []


def kept_in_worker(drop: Callable[[], None]) -> Callable[[], None]:
    """Registers ``drop``, which empties what a module keeps between the tasks
    of a Python worker (:func:`lean_worker`)."""
    _kept.append(drop)
    return drop


def lean_worker() -> None:
    """Called by a task that has large values of its own: Python workers are
    used again by later steps, and what earlier ones keep there would come on
    top."""
    for drop in _kept:
        drop()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: its lineage
    ends there, and every later reader sees the same rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` with the row key. A frame that is not a plain
    file scan is written out once, so that its rows get a stable place."""
    key = [F.xxhash64("_metadata.file_path").alias("_rf"),
           F.col("_metadata.row_index").alias("_rr")]
    try:
        out = df.select(*key, *columns)
        out.schema  # noqa: B018  resolves the metadata columns
        return out
    except AnalysisException:
        names = [f"c{i}" for i in range(len(columns))]
        plain = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n)
                            for c, n in zip(columns, names, strict=True)])
        want = [c if isinstance(c, str) else df.select(c).columns[0] for c in columns]
        staged = stage(plain, "keyed")
        return staged.select(*key, *[F.col(n).alias(w) for n, w in zip(names, want, strict=True)])


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """The only columns an operator reads; whatever else the table holds, or
    however it is named, never meets the operator's own columns."""
    return [F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("string").alias("text")]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return [t if t is not None else "" for t in column.to_pylist()]


def crc32_id(doc_id: Column) -> Column:
    """crc32 of the id written as text, the rule behind held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, key: str, n: int) -> tuple[Column, int]:
    """A column that maps ``key`` to 0..n-1 in key order, and the number of
    buckets. The bounds are literal numbers taken from approximate quantiles
    of the key alone, so every evaluation gives a row the same bucket. Null
    keys fall in bucket 0."""
    at = [i / n for i in range(1, n)]
    bounds = sorted(set(df.agg(F.percentile_approx(key, at, 10_000).alias("q")).first().q or [])) \
        if at else []
    if not bounds:
        return F.lit(0), 1
    # the literal array is searched by bisection with nested conditions over
    # at most n bounds; F.width_bucket needs equal widths
    return _bisect(F.col(key), bounds), len(bounds) + 1


def _bisect(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``key``. ``array_position``-like search by
    aggregate would test all bounds for each row; an array filter over a
    coarse and a fine list tests about twice the square root."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1::step]
    c = F.array(*[F.lit(int(b)).cast("long") for b in coarse])
    full = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
    first = F.size(F.filter(c, lambda b: b < key)) * F.lit(step)
    part = F.slice(full, first + F.lit(1), F.lit(step))
    return F.when(key.isNull(), F.lit(0)).otherwise(
        first + F.size(F.filter(part, lambda b: b < key))).cast("int")


def offsets(counts: DataFrame, order: list[str], sums: list[str],
            n: int) -> DataFrame:
    """Exclusive running sums of ``sums`` over the distinct integer key tuple
    ``order``, without one task for all rows: the leading key is cut into
    literal ranges, each range is summed by itself, and the ranges' totals
    (at most n rows) are carried over."""
    from pyspark.sql import Window as W

    bucket, n = range_bucket(counts, order[0], n)
    d = counts.withColumn("_b", bucket)
    totals = d.groupBy("_b").agg(*[F.sum(s).cast("long").alias(f"_t_{s}") for s in sums])
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("_b", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_c_{s}")
                                  for s in sums])
    inside = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({f"_s_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return d.join(F.broadcast(carry), "_b").select(
        *counts.columns, *[(F.col(f"_s_{s}") + F.col(f"_c_{s}")).alias(f"{s}_before") for s in sums])


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000,
            most_bytes: int = 16 << 20, weigh: Callable[[tuple], int] | None = None
            ) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows, or ``most_bytes`` as
    ``weigh`` sees them, from an iterator of tuples."""
    held: list[tuple] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += weigh(row) if weigh else 0
        if len(held) >= size or held_bytes >= most_bytes:
            yield _batch(held, schema)
            held, held_bytes = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def list_column(values: np.ndarray, lengths: Iterable[int], kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    ends = np.concatenate(([0], np.cumsum(np.fromiter(lengths, np.int64)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
