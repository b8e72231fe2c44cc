"""Repeated lines dropped by probing a sharded minimal perfect hash.

A line's key is the line without white space at its ends and with A-Z in
lower case; keys of ``LEAST_CODE_POINTS`` code points or more count. A key is
known by the 128 bits of its hash.

1. One pass over the texts yields each document's distinct key hashes, summed
   to documents and least id per hash (combined in the tasks that read).
2. Hashes of ``least_documents`` documents or more are dealt to shards by
   their low bits. Each shard becomes a minimal perfect hash - levels of bit
   arrays in which a key settles where no other key of its level falls - that
   gives its n keys the places 0..n-1 of three arrays: 64-bit fingerprints,
   numbers of documents, least ids. About 20.5 bytes a key.
3. Documents probe the arrays where their text is read. Lines are never
   shuffled or joined by key, so a line that every document holds costs no
   more than any other. A shard place whose fingerprint differs is no hit; a
   strange line is taken for a known one with a chance of 2^-64.

A task holds at most ``ARRAY_BYTES`` of arrays. If all shards need more, they
are cut into groups; then only hashes and line places are dealt to the groups
(by document, not by line), each task probes one group after the other, and
the places to drop come back to their document by its row key.

Defined cases: a null or empty text is one empty line. Rows of one repeated id
are documents of their own; all rows of the least id keep their lines. A null
id counts as larger than any other: such a document keeps a line only if no
document with an id holds it. Very long texts are split whole; a line of any
length is one key. An empty table gives an empty result. Columns besides id
and text are not read, so their names may clash with the operator's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ROW_KEY, documents, id_and_text, list_column, stage, texts, with_row_key
from turnlens.session import scratch_dir

LEAST_CODE_POINTS = 10
LEAST_DOCUMENTS = 2
#: Keys of a shard on average; a shard is built in one task.
SHARD_KEYS = 1 << 16
#: Bytes of arrays that a task holds at a time.
ARRAY_BYTES = 256 << 20
#: Bits of a level for each key that is still to be placed.
GAMMA = 2
#: Stands for a null id: larger than all others.
NO_ID = (1 << 63) - 1
SALTS = 64

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_digests(text: str) -> tuple[list[int], list[bytes], int]:
    """Places and key hashes of the lines that count, and the number of lines."""
    places, found = [], []
    lines = text.encode().lower().split(b"\n")  # bytes: A-Z alone change case
    for i, line in enumerate(lines):
        key = line.strip()  # \x20 and \x09-\x0D
        if len(key) >= LEAST_CODE_POINTS and (
                len(key) >= 4 * LEAST_CODE_POINTS or len(key.decode()) >= LEAST_CODE_POINTS):
            places.append(i)
            found.append(xxhash.xxh3_128_digest(key))
    return places, found, len(lines)


def _hashes(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, f, id): the distinct keys of each document."""
    for big in found:
        for a in range(0, big.num_rows, 1000):
            batch = big.slice(a, 1000)
            held, sizes = [], []
            for t in texts(batch.column(1)):
                own = set(line_digests(t)[1])
                held += own
                sizes.append(len(own))
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            both = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids, sizes))], names=["h", "f", "id"])


class PerfectHash:
    """A minimal perfect hash over pairs of 64-bit numbers."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.rank = np.concatenate(([0], before)).astype(np.uint32)

    @staticmethod
    def _at(h: np.ndarray, f: np.ndarray, level: int, bits: int) -> np.ndarray:
        x = (h ^ f * _C1) + np.uint64((level + 1) * int(_C2) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(32)) * _C1
        x = (x ^ x >> np.uint64(29)) * _C2
        return (x ^ x >> np.uint64(32)) % np.uint64(bits)

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h):
            bits = -(-GAMMA * len(h) // 64) * 64
            at = cls._at(h, f, len(sizes), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            h, f = h[~alone[at]], f[~alone[at]]
        return cls(sizes, np.concatenate(words) if words else np.empty(0, np.uint64))

    def places(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Place of each key; a pair that is no key gets -1 or any place."""
        out = np.full(len(h), -1, np.int64)
        left, start = np.arange(len(h)), 0
        for level, bits in enumerate(self.sizes):
            at = self._at(h[left], f[left], level, bits).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & (np.uint64(1) << bit[hit]) - np.uint64(1)
            out[left[hit]] = self.rank[at[hit] >> 6] + np.bitwise_count(below)
            left, start = left[~hit], start + bits
        return out


SHARD_SQL = "shard long, sizes array<long>, words binary, fingerprints binary, counts binary, owners binary"


def _build(table: pa.Table) -> pa.Table:
    """The hash and the arrays of one shard."""
    h, f, n, owner = (table.column(c).to_numpy() for c in ("h", "f", "n", "owner"))
    u, v = h.view(np.uint64), f.view(np.uint64)
    perfect = PerfectHash.build(u, v)
    at = perfect.places(u, v)
    arrays = []
    for values, kind in ((f, np.int64), (np.minimum(n, 0xFFFFFFFF), np.uint32), (owner, np.int64)):
        placed = np.empty(len(at), kind)
        placed[at] = values
        arrays.append(pa.array([placed.tobytes()], pa.binary()))
    return pa.Table.from_arrays(
        [table.column("shard").slice(0, 1).combine_chunks(), pa.array([perfect.sizes], pa.list_(pa.int64())),
         pa.array([perfect.words.tobytes()], pa.binary()), *arrays],
        names=["shard", "sizes", "words", "fingerprints", "counts", "owners"])


class Shard:
    def __init__(self, row: dict):
        self.perfect = PerfectHash(row["sizes"], np.frombuffer(row["words"], np.uint64))
        self.fingerprints = np.frombuffer(row["fingerprints"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.owners = np.frombuffer(row["owners"], np.int64)


#: Arrays that this worker holds: one group of one table at a time.
_held: dict[tuple, dict[int, Shard]] = {}


class LineArrays:
    """The staged arrays of all shards; goes to tasks by name only."""

    def __init__(self, path: str, shards: int, groups: int):
        self.path, self.shards, self.groups = path, shards, groups

    def group(self, g: int) -> dict[int, Shard]:
        if (self.path, g) not in _held:
            _held.clear()
            fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
            low, high = (-(-i * self.shards // self.groups) for i in (g, g + 1))
            rows = pads.dataset(path, filesystem=fs, format="parquet").to_batches(
                filter=(pads.field("shard") >= low) & (pads.field("shard") < high), batch_size=16)
            _held[self.path, g] = {row["shard"]: Shard(row) for b in rows for row in b.to_pylist()}
        return _held[self.path, g]

    def of(self, digests: np.ndarray) -> np.ndarray:
        """The group of each key hash."""
        return (digests[:, 0] & (self.shards - 1)) * self.groups // self.shards

    def dropped(self, g: int, digests: np.ndarray, ids: np.ndarray, least_documents: int) -> np.ndarray:
        """Whether each key (row of h, f), all of group g, is a repeated line
        that the document with this id loses."""
        out = np.zeros(len(digests), bool)
        shard = digests[:, 0] & (self.shards - 1)
        order = np.argsort(shard, kind="stable")
        ends = np.flatnonzero(np.diff(shard[order])) + 1
        held = self.group(g)
        for rows in np.split(order, ends) if len(order) else []:
            arrays = held.get(int(shard[rows[0]]))
            if arrays is None:
                continue
            h, f = digests[rows, 0], digests[rows, 1]
            at = arrays.perfect.places(h.view(np.uint64), f.view(np.uint64))
            out[rows] = ((at >= 0) & (arrays.fingerprints[at] == f) & (arrays.counts[at] >= least_documents)
                         & (arrays.owners[at] != ids[rows]))
        return out


def line_arrays(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, array_bytes: int = ARRAY_BYTES) -> LineArrays:
    """The arrays of all keys found in ``least_documents`` documents or more."""
    spark = docs.sparkSession
    keys = docs.select(*id_and_text(docs)).mapInArrow(_hashes, "h long, f long, id long")
    repeated = stage(keys.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("id").alias("owner"))
                     .filter(F.col("n") >= least_documents), "lines")
    n = repeated.count()
    shards = 1 << max(0, n // SHARD_KEYS).bit_length()
    built = repeated.withColumn("shard", F.col("h").bitwiseAND(shards - 1)) \
        .groupBy("shard").applyInArrow(_build, SHARD_SQL)
    path = scratch_dir(spark, "arrays")
    built.write.parquet(path)
    return LineArrays(path, shards, min(shards, -(-n * 21 // array_bytes) or 1))


def _keep(text: str, lost: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost) if lost else text


def _rows(kept: list[str], sizes: list[int], lost: list[int], ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())],
        names=["doc_id", "text", "n_lines", "n_dropped"])


OUT_SQL = "doc_id long, text string, n_lines long, n_dropped long"


def _probe(arrays: LineArrays, least_documents: int) -> Callable:
    """Drops lines where the text is read; all shards are held."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in found:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                held = texts(batch.column(1))
                lines = [line_digests(t) for t in held]
                digests = np.frombuffer(b"".join(d for x in lines for d in x[1]), "<i8").reshape(-1, 2)
                ends = np.cumsum([len(x[1]) for x in lines])[:-1]
                ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                gone = np.split(arrays.dropped(0, digests, np.repeat(ids, [len(x[1]) for x in lines]),
                                               least_documents), ends)
                lost = [{p for p, d in zip(x[0], g, strict=True) if d} if g.any() else set()
                        for x, g in zip(lines, gone, strict=True)]
                yield _rows([_keep(t, s) for t, s in zip(held, lost, strict=True)], [x[2] for x in lines],
                            [len(s) for s in lost], batch.column(0))
    return run


def _by_group(arrays: LineArrays) -> Callable:
    """(row key, group, id, places, digests): a document's keys of each group."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in found:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                out: list[tuple] = []
                for i, t in enumerate(texts(batch.column(3))):
                    places, held, _ = line_digests(t)
                    digests = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
                    group, at = arrays.of(digests), np.array(places, np.int32)
                    out += [(i, int(g), at[group == g], digests[group == g].tobytes()) for g in np.unique(group)]
                pick = pa.array([x[0] for x in out], pa.int64())
                flat = np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(j).take(pick) for j in range(3)], pa.array([x[1] for x in out], pa.int32()),
                     list_column(flat, [len(x[2]) for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())],
                    names=[*ROW_KEY, "doc_id", "group", "places", "digests"])
    return run


def _probe_groups(arrays: LineArrays, least_documents: int) -> Callable:
    """(row key, lost): places of the lines to drop; rows come by group."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows, out = batch.to_pylist(), []
            for r in rows:
                digests = np.frombuffer(r["digests"], "<i8").reshape(-1, 2)
                ids = np.full(len(digests), NO_ID if r["doc_id"] is None else r["doc_id"], np.int64)
                out.append(np.array(r["places"], np.int32)[arrays.dropped(r["group"], digests, ids, least_documents)])
            hit = [i for i, x in enumerate(out) if len(x)]
            flat = np.concatenate([out[i] for i in hit]) if hit else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(j).take(pa.array(hit, pa.int64())) for j in range(2)],
                 list_column(flat, [len(out[i]) for i in hit], pa.int32())], names=[*ROW_KEY, "lost"])
    return run


def _drop(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        held = texts(batch.column(1))
        lost = [set(x or ()) for x in batch.column(2).to_pylist()]
        yield _rows([_keep(t, s) for t, s in zip(held, lost, strict=True)], [t.count("\n") + 1 for t in held],
                    [len(s) for s in lost], batch.column(0))


def drop_repeated_lines(docs: DataFrame, arrays: LineArrays, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines (before), n_dropped."""
    if arrays.groups == 1:
        return docs.select(*id_and_text(docs)).mapInArrow(_probe(arrays, least_documents), OUT_SQL)
    keyed = with_row_key(docs, *id_and_text(docs))
    dealt = keyed.mapInArrow(_by_group(arrays), "_rf long, _rr long, doc_id long, group int, "
                             "places array<int>, digests binary")
    lost = dealt.repartition("group", F.pmod("_rr", F.lit(SALTS))).sortWithinPartitions("group") \
        .mapInArrow(_probe_groups(arrays, least_documents), "_rf long, _rr long, lost array<int>") \
        .groupBy(*ROW_KEY).agg(F.flatten(F.collect_list("lost")).alias("lost"))  # a document's own lines
    return keyed.join(lost, ROW_KEY, "left").select("doc_id", "text", "lost").mapInArrow(_drop, OUT_SQL)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return drop_repeated_lines(docs, line_arrays(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
