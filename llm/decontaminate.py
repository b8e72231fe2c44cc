"""Benchmark decontamination by winnowing.

Words are the runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing
A-Z. A window is ``WINDOW`` consecutive words of an item. Of each text the
k-gram hashes are winnowed: the least hash of every ``WINDOW - K + 1``
neighbouring k-grams is kept with its place. A span of ``WINDOW`` words has
exactly that many k-grams, so two texts that share one keep the same least
hash in it: no shared window is missed. That least hash is the window's
fingerprint. Fingerprints of documents and items are joined together with the
hash of their whole window, so a k-gram that many texts have in common meets
nothing unless the words around it agree too; the join's rows are the shared
windows. Each hit is then extended: windows of one item that overlap in the
document become one span. An item with fewer words is one window of its own
length; it enters with the hash of all its words, against document k-grams of
that length without winnowing.

Plan. Documents are read once: each task yields, per document, its number of
words and the windows whose kept hash and whole hash both pass bit tables of
the items' hashes. The tables have ``BITS_A_WINDOW`` bits a window of the
items, up to ``MOST_BITS``; beyond that they let more through, and the join,
which is exact on 128 bits, takes out the rest. The hits of a passage that
many documents share are spread by the join on the hashes; items with many
windows alike add rows for each item, as the result names every item.

Defined cases: null texts and texts without words have no words, no window
and are not contaminated. Very long texts are read whole; what a document
yields grows with its hits alone. Repeated rows and null ids are judged row by
row (rows are told apart by the place they were read from), and rows of equal
ids do not mix. Repeated item rows count once by item id; null item ids are
left out of the list of items but their windows count as hits. An empty
benchmark leaves every document clean; an empty table gives an empty result.
Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import ROW_KEY, batches, documents, id_and_text, stage, texts, with_row_key

WINDOW = 10
K = 5
#: Bits of a filter table for each window of the items, and the most it has.
BITS_A_WINDOW, MOST_BITS = 16, 1 << 26

#: ASCII A-Z to a-z, other ASCII outside 0-9 and a-z to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word of the text."""
    words = text.encode().translate(_FOLD).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash per run of k words; equal runs have equal hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + words[j:j + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """For each w neighbouring hashes the place of the kept one, the last
    least; neighbours mostly share it."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[w - 1:w - 1 + n].copy()
    at = np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        seen = grams[j:j + n]
        less = seen < least
        least[less] = seen[less]
        at[less] = np.flatnonzero(less) + j
    return at


def windows(words: np.ndarray, size: int, short: bool, window: int, k: int
            ) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and whole hash of every window of a text: of ``window``
    words, or of the ``size`` words of a short item."""
    if short:
        whole = gram_hashes(words, size)
        return whole, whole
    grams = gram_hashes(words, k)
    return grams[winnow(grams, window - k + 1)], gram_hashes(words, window)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _item_rows(window: int, k: int):
    schema = pa.schema([("item_id", pa.int64()), ("k", pa.int32()), ("short", pa.bool_()),
                        ("hash", pa.int64()), ("whole", pa.int64())])

    def rows(found: Iterator[pa.RecordBatch]):
        for batch in found:
            for item_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = word_hashes(text)
                if not len(words):
                    continue
                short = len(words) < window
                size = len(words) if short else window
                pairs = zip(*(_signed(h).tolist() for h in windows(words, size, short, window, k)), strict=True)
                for hash_, whole in dict.fromkeys(pairs):
                    yield item_id, size, short, hash_, whole

    return lambda found: batches(rows(found), schema, 5000)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW, k: int = K) -> DataFrame:
    """The fingerprints of all items with the hash of their window."""
    d = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return stage(d.mapInArrow(_item_rows(window, k), "item_id long, k int, short boolean, hash long, whole long")
                 .distinct(), "item-windows")


def _bit_table(hashes: DataFrame, bits: int) -> bytes:
    """Bits set at the hashes, packed. Tasks send their own packed tables,
    which are joined by place."""
    def local(found: Iterator[pa.RecordBatch]):
        table = np.zeros(bits >> 3, np.uint8)
        for batch in found:
            h = batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64),
                             np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].astype(np.int32))],
                                         names=["place", "value"])

    merged = hashes.mapInArrow(local, "place long, value int").groupBy("place").agg(F.bit_or("value").alias("value"))
    table = np.zeros(bits >> 3, np.uint8)
    found = merged.toArrow()  # at most bits / 8 rows
    table[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return table.tobytes()


def _filters(item_rows: DataFrame, bits: int | None) -> tuple:
    """Bit tables of fingerprints and of whole windows, and the kinds of item
    rows: number of words hashed, and whether they are a whole short item."""
    bits = bits or min(MOST_BITS, 1 << max(10, (item_rows.count() * BITS_A_WINDOW).bit_length()))
    kinds = [(r.k, r.short) for r in item_rows.select("k", "short").distinct().collect()]  # at most WINDOW rows
    return _bit_table(item_rows.select("hash"), bits), _bit_table(item_rows.select("whole"), bits), kinds


def _document_rows(shared, window: int, k: int):
    hit = pa.struct([("k", pa.int32()), ("short", pa.bool_()), ("hash", pa.int64()), ("whole", pa.int64()),
                     ("at", pa.int64())])
    schema = pa.schema([("_rf", pa.int64()), ("_rr", pa.int64()), ("doc_id", pa.int64()),
                        ("n_words", pa.int64()), ("hits", pa.list_(hit))])

    def rows(found: Iterator[pa.RecordBatch]):
        *tables, kinds = shared.value
        one, two = (np.frombuffer(t, np.uint8) for t in tables)
        mask = np.uint64(len(one) * 8 - 1)

        def known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
            h = hashes & mask
            return (table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1) == 1

        for batch in found:
            keys = [batch.column(c).to_pylist() for c in range(3)]
            for rf, rr, doc_id, text in zip(*keys, texts(batch.column(3)), strict=True):
                words = word_hashes(text)
                hits = []
                for size, short in kinds:
                    hashes, whole = windows(words, size, short, window, k)
                    at = np.flatnonzero(known(one, hashes))
                    at = at[known(two, whole[at])]
                    hits += [{"k": size, "short": short, "hash": h, "whole": w, "at": a} for h, w, a in zip(
                        _signed(hashes[at]).tolist(), _signed(whole[at]).tolist(), at.tolist(), strict=True)]
                yield rf, rr, doc_id, len(words), hits

    return lambda found: batches(rows(found), schema, 5000, 4 << 20, lambda r: 64 + 40 * len(r[4]))


def shared_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K,
                   filter_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents: row key, doc_id, n_words, from a written table; windows:
    row key, item_id, first and end word, one row per shared window).
    ``filter_bits`` (a power of two) overrides the size of the bit tables."""
    item_rows = item_windows(items, window=window, k=k)
    shared = docs.sparkSession.sparkContext.broadcast(_filters(item_rows, filter_bits))  # MOST_BITS / 4
    rows = stage(with_row_key(docs, *id_and_text(docs)).mapInArrow(
        _document_rows(shared, window, k), "_rf long, _rr long, doc_id long, n_words long, "
        "hits array<struct<k: int, short: boolean, hash: long, whole: long, at: long>>"), "document-windows")
    met = rows.select(*ROW_KEY, F.explode("hits").alias("h")).select(*ROW_KEY, "h.*") \
        .join(item_rows, ["k", "short", "hash", "whole"])
    return rows.select(*ROW_KEY, "doc_id", "n_words"), met.select(
        *ROW_KEY, "item_id", F.col("at").alias("first"), (F.col("at") + F.col("k")).alias("end"))


def _merged(spans: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping spans of a group as one; a group is what one document
    shares (with one item)."""
    along = W.partitionBy(*by).orderBy("first", "end")
    reach = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.coalesce(F.col("first") > reach, F.lit(True)).cast("int"))
    return starts.withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0))) \
        .groupBy(*by, "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("run")


def hits(docs: DataFrame, items: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(documents: row key, doc_id, n_words; spans: row key, item_id, first
    and end word of each run of shared windows). Both come from written tables."""
    rows, met = shared_windows(docs, items, **options)
    return rows, stage(_merged(met, [*ROW_KEY, "item_id"]), "spans")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document with the row key, its words, how many of them lie
    in an occurring window, and the items whose windows occur."""
    rows, spans = hits(docs, items, **options)
    # words of spans of several items count once
    n_hit = _merged(spans.select(*ROW_KEY, "first", "end"), ROW_KEY).groupBy(*ROW_KEY).agg(
        F.sum(F.col("end") - F.col("first")).cast("long").alias("n_hit"))
    named = spans.groupBy(*ROW_KEY).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = rows.join(n_hit.join(named, ROW_KEY), ROW_KEY, "left")
    none = F.array().cast("array<string>")
    return found.select(*ROW_KEY, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                        F.coalesce("items", none).alias("items"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
