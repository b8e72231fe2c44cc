"""Bounded-space online best-fit packing of tokenized documents.

A packer holds at most ``open_bins`` open sequences. An integer serves as a
bitset keyed by free space: bit f is set while some open sequence has exactly
f places left, so the tightest open sequence that takes a piece is found with
two bit operations. If none takes it and all places are in use, the fullest
closes first. Each task packs the documents of its own input split; the
stream is ordered by decreasing length within chunks of as many tokens as the
open sequences hold. Sequences still open at the end of a task that have over
a sixteenth of their space left are then packed as pieces themselves, in
groups of bounded size, so the loss at task borders does not grow with the
number of tasks.

Defined cases: a null or empty text is one piece of length 1 (the end id).
Null and repeated ids are packed row by row. An empty table gives an empty
result. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import tokens
from llm.common import batches, crc32, documents, id_and_text, stage, texts

SEQUENCE = 4096
OPEN_BINS = 4096
#: Left-open sequences that one task packs together.
MERGE_ROWS = 50_000


class BestFit:
    """Online best fit over bins of ``size`` with at most ``open_bins`` open.
    ``add`` and ``rest`` yield closed bins as (number, used, items), where an
    item is (payload, place in the bin)."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.most = size, open_bins
        self.by_free: dict[int, list[tuple[int, list]]] = {}
        self.bits = 0
        self.n_open = self.made = 0

    def _take(self, free: int) -> tuple[int, list]:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def _least(self, need: int) -> int | None:
        """Smallest free space of at least ``need`` among the open bins."""
        rest = self.bits >> need
        return need + (rest & -rest).bit_length() - 1 if rest else None

    def add(self, length: int, payload) -> Iterator[tuple[int, int, list]]:
        free = self._least(length)
        if free is None:
            if length < self.size and self.n_open == self.most:
                fullest = self._least(0)
                number, items = self._take(fullest)
                yield number, self.size - fullest, items
            free, number, items = self.size, self.made, []
            self.made += 1
        else:
            number, items = self._take(free)
        items.append((payload, self.size - free))
        free -= length
        if free == 0:
            yield number, self.size, items
        else:
            self.by_free.setdefault(free, []).append((number, items))
            self.bits |= 1 << free
            self.n_open += 1

    def rest(self) -> Iterator[tuple[int, int, list]]:
        for free, held in sorted(self.by_free.items()):
            for number, items in held:
                yield number, self.size - free, items


PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
         ("length", pa.int64()), ("ids_crc32", pa.int64())]
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, size: int, chunk_tokens: int):
    schema = pa.schema([*PIECE, ("chunk", pa.int64())])

    def rows(found: Iterator[pa.RecordBatch]):
        encode = tokens.Encoder(path)
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in found:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, ids in zip(doc_ids, encode(texts(batch.column(1))), strict=True):
                for piece, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a:a + 4 * size]
                    seen += len(part) // 4
                    yield doc_id, piece, a // 4, len(part) // 4, crc32(part), first + seen // chunk_tokens

    return lambda found: batches(rows(found), schema)


def _pack(size: int, open_bins: int):
    schema = pa.schema([*PIECE, ("bin", pa.int64()), ("offset", pa.int64()), ("open", pa.int64())])

    def rows(found: Iterator[pa.RecordBatch]):
        first = TaskContext.get().partitionId() << 32
        packer = BestFit(size, open_bins)

        def out(closed, at_end: bool):
            for number, used, items in closed:
                left_open = used if at_end and 16 * (size - used) > size else 0
                for piece, place in items:
                    yield *piece, first + number, place, left_open

        for batch in found:
            columns = [batch.column(c).to_pylist() for c in range(len(PIECE))]
            for piece in zip(*columns, strict=True):
                yield from out(packer.add(piece[3], piece), False)
        yield from out(packer.rest(), True)

    return lambda found: batches(rows(found), schema)


def _merge(size: int, open_bins: int):
    schema = pa.schema([("bin", pa.int64()), ("sequence_id", pa.int64()), ("shift", pa.int64())])

    def rows(found: Iterator[pa.RecordBatch]):
        packer = BestFit(size, open_bins)

        def out(closed):
            for _, _, items in closed:
                for number, place in items:
                    yield number, items[0][0], place

        for batch in found:
            for number, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from out(packer.add(used, number))
        yield from out(packer.rest())

    return lambda found: batches(rows(found), schema)


def pack(docs: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS,
         path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. Sequence ids are unique, not consecutive."""
    # written in between, so that no task runs two Python workers
    pieces = stage(docs.select(*id_and_text(docs)).mapInArrow(
        _cut(path or tokens.tokenizer_path(), size, size * open_bins), PIECE_SQL + ", chunk long"), "pieces")
    packed = stage(
        pieces.sortWithinPartitions("chunk", F.desc("length"), "doc_id", "piece", "ids_crc32")
        .drop("chunk").mapInArrow(_pack(size, open_bins),
                                  PIECE_SQL + ", bin long, offset long, open long"), "packed")
    left = packed.filter("open > 0").groupBy("bin").agg(F.max("open").alias("used"))
    left = stage(left, "open-bins")
    groups = max(1, left.count() // MERGE_ROWS)
    merged = (left.withColumn("g", F.pmod(F.xxhash64("bin"), F.lit(groups)))
              .repartition(groups, "g").sortWithinPartitions("g", F.desc("used"), "bin")
              .select("bin", "used")
              .mapInArrow(_merge(size, open_bins), "bin long, sequence_id long, shift long"))
    return packed.join(stage(merged, "merged-bins"), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
