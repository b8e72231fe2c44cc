"""Near-duplicate groups by b-bit MinHash.

A document's set is its distinct shingles of ``width`` words (2 unless asked
otherwise) over words ``[^\x20\x09-\x0D]+`` with A-Z in lower case; a text of
fewer words is one shingle. Texts with equal sets form one class, and all
later work is on classes. Per class the first pass over the texts yields
``BANDS * ROWS`` minima as band keys; two low bits of each mixed minimum,
packed into bit planes; and a parity sketch of the whole set.

1. Candidates share a band key. Each class is paired with one lead of each of
   its buckets, so a bucket of m classes gives m - 1 pairs. The lead is the
   class whose buckets hold the most classes in all: among near copies of one
   text that is the text itself or the copy least changed, to which the others
   link even where two copies are too far from each other.
2. Pairs are dropped whose collision-corrected b-bit estimate is below
   ``LEAST_ESTIMATE`` (over five deviations under the limit), or whose parity
   sketches differ in more bits than linked sets can (a bound, not an
   estimate). The rest is confirmed on the full sets.
3. Confirmed links give components. A bucket whose classes are in one
   component needs no more pairs. The classes of the others are joined by an
   exact prefix filter: the shingles of a set are ordered from rare to
   frequent (among these classes), and two sets of similarity 0.8 share one of
   the first n - ceil(0.8 n) + 1 of each. So pages of one template, whose
   common words are frequent and whose own words are rare, meet in no list,
   however many there are. In a list only pairs across components are formed,
   those whose places in the two orders leave room for enough common
   shingles; they are estimated and confirmed alike. So every candidate pair
   is either connected or tested or cannot be linked, and no bucket is capped.

With 48 bands of 6 rows a pair of similarity 0.8 shares a band with
probability 1 - 5e-7. Sets are built a second time only for classes with a
pair to confirm or in a bucket of several components.

Defined cases: null texts and texts without words have the empty set, are
linked with nothing and are kept. Very long texts are read whole; their sets
travel once for each ``PAIRS_A_SET`` pairs at most. Repeated rows are one
class; ``kept`` holds for each row whose id is the component's least, ``first``
for exactly one row of each component (ties of the id: by file and place).
Null ids come last; a component of null ids alone has a null component_id and
its rows are kept. Columns besides id and text are not read, so their names
may clash with the operator's. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import ROW_KEY, documents, id_and_text, lean_worker, list_column, stage, texts, with_row_key
from llm.components import components

SIMILARITY = (80, 100)
BANDS, ROWS = 48, 6
LEAST_ESTIMATE = 0.65
#: Longs per bit plane (BANDS * ROWS bits, padded) and per parity sketch.
PLANE, SKETCH = -(-BANDS * ROWS // 64), 16
#: Rows of (row key, class) that are broadcast at most (24 bytes each).
BROADCAST_ROWS = 200_000
#: Bands by which a bounded sample is searched for copies: a pair of similarity
#: 0.8 shares one with probability 0.9993.
SAMPLE_BANDS = 24
#: Pairs for which one copy of a class's set is sent, on average over a class
#: with many pairs.
PAIRS_A_SET = 1000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.default_rng(20_240_229)
_A = _SEEDS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEEDS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _SEEDS.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a text of
    fewer words is one run."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = (s + h[j:j + len(s)]) * _C1
        s ^= s >> np.uint64(29)
    return np.unique(s * _C2)


def minima(s: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 256):
        np.minimum(least, (s[a:a + 256, None] * _A + _B).min(0), out=least)
    return least


def _packed(bits: np.ndarray, longs: int) -> np.ndarray:
    """Rows of 0/1 values as rows of ``longs`` 64-bit integers."""
    out = np.zeros((len(bits), longs * 8), np.uint8)
    packed = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    out[:, :packed.shape[1]] = packed
    return out.view(np.int64)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, bit planes and parity sketches of non-empty sets."""
    m = np.stack([minima(s) for s in sets])
    parity = np.stack([np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=1024) & 1 for s in sets])
    by_band = m.reshape(len(m), BANDS, ROWS)
    keys = (by_band * _MIX).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C2
    keys = (keys ^ keys >> np.uint64(31)) * _C1
    low = m * _C2 >> np.uint64(62)
    planes = np.hstack([_packed(low & np.uint64(1), PLANE), _packed(low >> np.uint64(1), PLANE)])
    return keys.view(np.int64), planes, _packed(parity, SKETCH)


ROWS_SQL = ("_rf long, _rr long, doc_id long, n long, digest binary, keys array<long>, "
            "planes array<long>, sketch array<long>")


def _document_rows(width: int) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for big in found:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                sets = [shingles(t, width) for t in texts(batch.column(3))]
                full = [i for i, s in enumerate(sets) if len(s)]
                sizes = np.zeros(len(sets), np.int64)
                sizes[full] = 1
                signs = _signatures([sets[i] for i in full]) if full else [np.empty((0, 0), np.int64)] * 3
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     *[list_column(x.ravel(), sizes * w, pa.int64())
                       for x, w in zip(signs, (BANDS, 2 * PLANE, SKETCH), strict=True)]],
                    names=["_rf", "_rr", "doc_id", "n", "digest", "keys", "planes", "sketch"])
    return run


def _set_rows(width: int) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for big in found:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                sets = [shingles(t, width) for t in texts(batch.column(1))]
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), list_column(flat, [len(s) for s in sets], pa.int64())], names=["c", "s"])
    return run


def _unlike(x: str, y: str, a: int, b: int) -> Column:
    """Number of bits that differ between longs a..b-1 of two arrays."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(a + 1, b)),
               F.bit_count(F.get(x, F.lit(a)).bitwiseXOR(F.get(y, F.lit(a)))))


def _may_link(x: str, y: str) -> Column:
    """Whether two signed classes, structs x and y, can be linked: by set
    sizes, by the b-bit estimate, and by the parity bound."""
    part, whole = SIMILARITY
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = BANDS * ROWS
    planes = [[F.get(f"{s}.planes", F.lit(i)) for i in range(2 * PLANE)] for s in (x, y)]
    differ = None
    for i in range(PLANE):
        either = planes[0][i].bitwiseXOR(planes[1][i]).bitwiseOR(
            planes[0][PLANE + i].bitwiseXOR(planes[1][PLANE + i]))
        differ = F.bit_count(either) if differ is None else differ + F.bit_count(either)
    # equal pairs of low bits happen by chance once in four
    most = int(bits * (1 - LEAST_ESTIMATE) * 0.75)
    # linked sets differ in at most (n + m) (whole - part) / (whole + part) shingles
    bound = (n + m) * F.lit(whole - part)
    return ((F.least(n, m) * whole >= F.greatest(n, m) * part) & (differ <= most)
            & (_unlike(f"{x}.sketch", f"{y}.sketch", 0, SKETCH) * F.lit(whole + part) <= bound))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), read from a written table, whose ``sets`` (c, s) pass
    the limit. The pairs of an entry are dealt to parts, and its set is sent
    once to each part that has any, so an entry with very many pairs is no
    single key."""
    parts = max(1, pairs.count() // PAIRS_A_SET)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(parts)).alias("pa"),
                         F.pmod(F.xxhash64("a"), F.lit(parts)).alias("pb"))

    def with_set(side: str, part: str, out: str) -> DataFrame:
        copies = dealt.select(side, part).distinct()
        return copies.join(sets.select(F.col("c").alias(side), F.col("s").alias(out)), side)

    part, whole = SIMILARITY
    both = F.size(F.array_intersect("x", "y"))
    return (dealt.join(with_set("b", "pb", "y"), ["b", "pb"]).join(with_set("a", "pa", "x"), ["a", "pa"])
            .filter(both * whole >= (F.size("x") + F.size("y") - both) * part).select("a", "b"))


def sample_copies(sample: DataFrame) -> DataFrame:
    """(c, order, copy) for each row (c, order, text) of a bounded sample, read
    from a written table: whether its set is similar to that of a row of
    lesser (order, c). Each row is compared with the least row of each of its
    buckets in the first ``SAMPLE_BANDS`` bands, in one round without
    components; null where a text has no words."""
    def signed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for big in found:
            for a in range(0, big.num_rows, 500):
                batch = big.slice(a, 500)
                sets = [shingles(t) for t in texts(batch.column(2))]
                full = [s for s in sets if len(s)]
                keys = _signatures(full)[0][:, :SAMPLE_BANDS] if full else np.empty((0, SAMPLE_BANDS), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     list_column(keys.ravel(), [SAMPLE_BANDS * (len(s) > 0) for s in sets], pa.int64())],
                    names=["c", "order", "keys"])

    rows = stage(sample.select("c", "order", "text").mapInArrow(
        signed, "c long, order long, keys array<long>"), "sample-keys")
    held = rows.select(F.explode("keys").alias("key"), F.struct("order", "c").alias("me"))
    leads = stage(held.groupBy("key").agg(F.min("me").alias("lead"), F.max("me").alias("last"))
                  .filter("lead < last").select("key", "lead"), "sample-leads")
    pairs = stage(held.join(leads, "key").filter("lead < me").select(
        F.col("lead.c").alias("a"), F.col("me.c").alias("b")).distinct(), "sample-pairs")
    # sets are built again, for rows with a pair only; no more rows than the sample has
    paired = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    sets = stage(sample.join(F.broadcast(paired), "c").select("c", "text")
                 .mapInArrow(_set_rows(2), "c long, s array<long>"), "sample-sets")
    copies = confirmed(pairs, sets).select(F.col("b").alias("c")).distinct().withColumn("copy", F.lit(True))
    return rows.select("c", "order", F.size("keys").alias("n")).join(copies, "c", "left").select(
        "c", "order", F.when(F.col("n") > 0, F.coalesce("copy", F.lit(False))).alias("copy"))


class NearDuplicates:
    """Classes, confirmed links and components of a table of documents."""

    def __init__(self, docs: DataFrame, width: int = 2):
        keyed = with_row_key(docs, *id_and_text(docs))
        self.width = width
        self.text = keyed.select(*ROW_KEY, "text")
        self.rows = stage(keyed.mapInArrow(_document_rows(width), ROWS_SQL), "signatures")
        head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
        grouped = self.rows.filter("digest is not null").groupBy("digest").agg(
            F.min(head).alias("head"), *[F.first(c).alias(c) for c in ("n", "keys", "planes", "sketch")])
        self.classes = stage(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.signed = self.classes.select("c", F.struct("n", "planes", "sketch").alias("sign"))

    def members(self) -> DataFrame:
        """(key, c, lead) for every class in a bucket of two or more. The lead
        is the class whose buckets hold the most classes in all."""
        held = self.classes.select(F.explode("keys").alias("key"), "c")
        shared = held.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
        near = F.sum("m").over(Window.partitionBy("c"))  # at most BANDS rows
        held = stage(held.join(shared, "key").select("key", "c", near.alias("near")), "held")
        leads = held.groupBy("key").agg(F.max(F.struct("near", "c")).alias("lead"))
        return stage(held.join(leads, "key").select("key", "c", F.col("lead.c").alias("lead")), "buckets")

    def sets(self, classes: DataFrame) -> DataFrame:
        """(c, s): the full sets of the classes c, each read from its first row."""
        wanted = stage(classes.join(self.classes.select("c", "head"), "c").select("c", "head._rf", "head._rr"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        return stage(self.text.join(wanted, ROW_KEY).select("c", "text")
                     .mapInArrow(_set_rows(self.width), "c long, s array<long>"), "sets")

    def confirm(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose full sets pass the limit."""
        pairs = stage(pairs, "pairs")
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct())
        return confirmed(pairs, sets)

    def may_link(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that estimate and bounds leave open."""
        sign = lambda side, out: self.signed.select(F.col("c").alias(side), F.col("sign").alias(out))
        return pairs.join(sign("a", "x"), "a").join(sign("b", "y"), "b").filter(_may_link("x", "y")).select("a", "b")

    def star_pairs(self, members: DataFrame) -> DataFrame:
        return self.may_link(members.filter("c <> lead").select(
            F.least("lead", "c").alias("a"), F.greatest("lead", "c").alias("b")).distinct())

    def prefixes(self, placed: DataFrame, sets: DataFrame) -> DataFrame:
        """(shingle, c, label, n, place): the first shingles of each class in
        the order from rare to frequent, without those that no other has."""
        part, whole = SIMILARITY
        single = sets.select("c", F.size("s").alias("n"), F.explode("s").alias("shingle"))
        # written out: the join below can then split a frequent shingle
        often = stage(single.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"), "frequency")
        ordered = single.join(often, "shingle", "left").groupBy("c", "n").agg(F.array_sort(F.collect_list(
            F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("all"))  # one document's set
        first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * part / whole).cast("int") + 1)
        return (ordered.select("c", "n", F.posexplode(first).alias("place", "x")).filter("x.df > 1")
                .join(placed, "c").select("x.shingle", "c", "label", "n", "place"))

    def rest_pairs(self, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs across components among the classes whose buckets hold
        several, and the sets of these classes."""
        placed = members.select("key", "c").join(labels.withColumnRenamed("node", "c"), "c", "left") \
            .withColumn("label", F.coalesce("label", "c"))
        mixed = stage(placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"))
                      .filter("l < m").select("key"), "mixed")
        placed = stage(placed.join(mixed, "key").select("c", "label").distinct(), "placed")
        sets = self.sets(placed.select("c"))
        rows = stage(self.prefixes(placed, sets), "prefixes")
        lists = rows.groupBy("shingle", "label").agg(F.count("*").alias("m")).groupBy("shingle").agg(
            F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
        rows = rows.join(stage(lists.select("shingle", F.col("top.label").alias("most")), "lists"), "shingle")
        side = lambda s: F.struct("c", "label", "n", "place").alias(s)
        few = rows.filter("label <> most").select("shingle", side("x"))
        all_ = rows.select("shingle", side("y"), (F.col("label") == F.col("most")).alias("in_most"))
        part, whole = SIMILARITY
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        room = F.least(x("n") - x("place"), y("n") - y("place")) * (part + whole) >= (x("n") + y("n")) * part
        met = few.join(all_, "shingle").filter(
            (x("label") != y("label")) & (F.col("in_most") | (x("c") < y("c")))
            & (F.least(x("n"), y("n")) * whole >= F.greatest(x("n"), y("n")) * part) & room)
        pairs = met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        return self.may_link(pairs), sets

    def labels(self) -> DataFrame:
        """(c, label) of every class with a link."""
        members = self.members()
        links = stage(self.confirm(self.star_pairs(members)), "links")
        labels = components(links)
        more = stage(self.confirm(*self.rest_pairs(members, labels)), "links")
        # components of components: only the new links and their labels matter
        label = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        over = components(more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(
            F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        linked = labels.select(F.col("node").alias("c"), "label").unionByName(
            over.join(labels, "node", "left_anti").select(F.col("node").alias("c"), F.col("node").alias("label")))
        return linked.join(over.withColumnRenamed("label", "top"), linked.label == over.node, "left").select(
            "c", F.coalesce("top", linked.label).alias("label"))

    def result(self) -> DataFrame:
        """One row per document: row key, doc_id, n_shingles, component_id,
        kept and first."""
        heads = stage(self.classes.select("c", "digest", "head").join(self.labels(), "c", "left")
                      .withColumn("label", F.coalesce("label", "c")), "heads")
        # written out: the join can then split a component of very many classes
        tops = stage(heads.groupBy("label").agg(F.min("head").alias("top")), "tops")
        named = heads.join(tops, "label").select("digest", "top")
        found = self.rows.select(*ROW_KEY, "doc_id", "n", "digest").join(named, "digest", "left")
        alone = F.col("digest").isNull()
        component = F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id"))
        return found.select(
            *ROW_KEY, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
            (alone | ((F.col("top._rf") == F.col("_rf")) & (F.col("top._rr") == F.col("_rr")))).alias("first"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(documents(spark, sf_dir)).result().select(
        "doc_id", "n_shingles", "component_id", "kept")
