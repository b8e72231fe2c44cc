"""Minimax contiguous sharding of documents, groups of equal texts kept whole.

Groups of equal texts, in the order of their smallest id, form a line of
atomic sizes. The smallest capacity C for which a greedy walk needs at most
``shards`` shards is found by search over the whole numbers between
max(total / shards, largest group) and that plus the largest group. The walk needs one look-up a shard
("the last group border at or before x"); every job answers the look-ups of
``PROBES`` capacities at once with one small aggregate over the line's
borders, so no list of groups reaches the driver. The cuts are then made
under that capacity: each shard takes its share of what is left, moved only
as far as the capacity of the later shards asks for.

The line is laid out by ranges of (smallest id, group, id), written out at
once so that ranges and places stay as they are; a hot group's rows spread
over many ranges. Running sums are taken inside each range and shifted by the
totals of earlier ranges.

Defined cases: a null text has 0 bytes and all null texts form one group,
apart from the empty text. Null ids come first. Repeated rows stay separate
rows of one group. An empty table gives an empty result; with fewer groups
than shards some shards stay empty. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import documents, id_and_text, partitions, stage

PROBES = 32


def rows_and_groups(docs: DataFrame) -> DataFrame:
    """Per document: id, size, text_crc32, and a key that equal texts share."""
    text = F.col("text")
    return docs.select(*id_and_text(docs)).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("text_key"))


def _running(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, per bucket of the sorted stream, the place of each row and the
    bytes before it."""
    bucket, rows, total = None, 0, 0
    for batch in found:
        if not batch.num_rows:
            continue
        b = batch.column("bucket").to_numpy(zero_copy_only=False)
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        start = np.empty(len(b), np.int64)
        place = np.empty(len(b), np.int64)
        borders = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
        for i, j in zip(borders, borders[1:], strict=False):
            if b[i] != bucket:
                bucket, rows, total = b[i], 0, 0
            sums = np.cumsum(sizes[i:j])
            start[i:j] = total + sums - sizes[i:j]
            place[i:j] = rows + np.arange(j - i)
            rows, total = rows + j - i, total + int(sums[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place), pa.array(start)],
            names=[*batch.schema.names, "place", "start"])


def line(docs: DataFrame) -> DataFrame:
    """All rows in the order (smallest id of the group, group, id), with their
    place ``row`` and the bytes before them, ``start``."""
    rows = stage(rows_and_groups(docs), "rows")
    heads = rows.groupBy("text_key").agg(F.min("doc_id").alias("head"))
    order = ["head", "text_key", "doc_id"]
    d = (rows.join(heads, "text_key").repartitionByRange(partitions(docs.sparkSession), *order)
         .sortWithinPartitions(*order)
         .select("doc_id", "size", "text_crc32", "head", "text_key",
                 F.spark_partition_id().cast("long").alias("bucket")))
    placed = stage(d.mapInArrow(_running, d.schema.simpleString()[7:-1].replace(":", " ")
                                + ", place long, start long"), "line")
    totals = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before")
                                      for c in ("n", "bytes")])
    # as many rows as shuffle partitions
    return placed.join(F.broadcast(carry), "bucket").select(
        "doc_id", "size", "text_crc32", "head", "text_key",
        (F.col("place") + F.col("n_before")).alias("row"),
        (F.col("start") + F.col("bytes_before")).alias("start"))


class Borders:
    """Look-ups among the places where a group starts, and the line's end."""

    def __init__(self, rows: DataFrame):
        groups = rows.groupBy("head", "text_key").agg(
            F.min("start").alias("border"), F.sum("size").alias("bytes"))
        self.table = stage(groups.select("border", "bytes").repartitionByRange(
            partitions(rows.sparkSession), "border").sortWithinPartitions("border"), "borders")
        r = self.table.agg(F.max("bytes").alias("most"), F.sum("bytes").alias("total")).first()
        self.largest, self.total = r.most or 0, r.total or 0

    def around(self, places: Iterable[int]) -> dict[int, tuple[int, int]]:
        """For each place, the last border at or before it and the first at or
        after it. Borders farther away than the largest group can't be either,
        so the scan skips them."""
        at = sorted(set(places))
        near = self.table.filter(F.col("border").between(
            at[0] - self.largest, at[-1] + self.largest))
        known = F.array(*[F.lit(x).cast("long") for x in at])
        found = near.groupBy(F.size(F.filter(known, lambda x: x < F.col("border"))).alias("i")).agg(
            F.min("border").alias("a"), F.max("border").alias("b")).collect()
        low, high = {r.i: r.a for r in found}, {r.i: r.b for r in found}
        out, last = {}, 0
        for i, x in enumerate(at):
            last = max(last, high.get(i, 0), self.total if self.total <= x else 0)
            after = [low[j] for j in range(i + 1, len(at) + 1) if j in low][:1] or [self.total]
            out[x] = (last, last if last == x else after[0])
        return out


def smallest_capacity(borders: Borders, shards: int, probes: int = PROBES) -> int:
    """Least bytes a shard must hold so that a greedy walk fits ``shards``."""
    least = max(-(-borders.total // shards), borders.largest)
    most = -(-borders.total // shards) + borders.largest  # always enough
    while least < most:
        step = max(1, (most - least) // probes)
        tried = list(range(least, most, step))
        reached = dict.fromkeys(tried, 0)
        for _ in range(shards):
            open_ = [c for c in tried if reached[c] < borders.total]
            if not open_:
                break
            found = borders.around(reached[c] + c for c in open_)
            reached |= {c: found[reached[c] + c][0] for c in open_}
        fits = [c for c in tried if reached[c] == borders.total]
        most = min([*fits, most])
        least = max([c + 1 for c in tried if c < most], default=least)
    return most


def cuts(borders: Borders, shards: int) -> list[int]:
    """Ends of the shards under the smallest capacity. Each shard ends at the
    border next to an equal share of the rest, as far as the capacity of this
    and of the later shards allows."""
    if not borders.total:
        return [0] * shards
    c = smallest_capacity(borders, shards)
    least = [borders.total]
    for _ in range(shards - 1):
        x = max(0, least[-1] - c)
        least.append(borders.around([x])[x][1] if x else 0)
    least.reverse()
    ends, at = [], 0
    for k in range(shards - 1):
        goal = at + (borders.total - at) // (shards - k)
        found = borders.around([goal, at + c])
        best = min(found[goal], key=lambda p: abs(p - goal))
        at = min(max(best, least[k], at), found[at + c][0])
        ends.append(at)
    return [*ends, borders.total]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot, its
    place within the shard."""
    rows = line(docs)
    ends = cuts(Borders(rows), shards)
    found = rows.withColumn("shard", sum(
        ((F.col("start") >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0)))
    first = {r.shard: r.first for r in found.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    at = F.coalesce(*[F.when(F.col("shard") == k, F.lit(v)) for k, v in first.items()], F.lit(0))
    return found.select("doc_id", "size", "text_crc32", "shard",
                        (F.col("row") - at).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))
