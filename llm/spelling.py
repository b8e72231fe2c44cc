"""Spelling variants: words one edit apart, found through a variable-length
gram index.

1. Gram dictionary. Grams of ``SHORTEST`` to ``LONGEST`` code points are
   counted over the words. A gram found more often than the threshold is
   frequent and is expanded to the grams one code point longer; below a rare
   gram nothing is kept. The threshold is the least one (``LEAST_LIST`` at
   least) that bounds the frequent grams by ``MOST_GRAMS``; only they are sent
   to the tasks.
2. Decomposition. At every place a word has the one gram that starts with the
   shortest and grows while it is frequent, to half the word's length at most.
   So common beginnings become long grams and rare ones stay short.
3. Affected grams. One edit at a place changes only the grams that cover it;
   the most that any place has is the word's bound (:func:`affected`). Two
   words one edit apart share all other grams, at least (grams - bound) of
   them; half the length as the longest gram leaves two or more.
4. List merging. For each place an edit can have, a word stands in one list:
   that of the grams which the edit leaves unaffected, each with its place
   (after an added code point, one further). Words one edit apart agree on
   these grams, so they meet in the list of that place, and the merge of their
   gram lists, with the bound of that very place, is the list itself. Words
   that share some frequent grams only never meet.
5. The edit distance of each pair that meets decides.

Words of n and of n or n + 1 code points are compared with grams cut for n
(the family n), so both sides decompose alike. Pairs that meet twice are
reported once; no list of words is held by one task, and Spark splits the
join's large lists.

Forms: the near word of the largest count, if that is ``RATIO`` times the
word's own; roots follow forms to the end by doubling steps.

Defined cases: null and empty texts have no words. The id is part of the hash
that decides planted deletions; a null id is written as empty. Rows of one id
are counted one by one. Of equally frequent near words the smallest in
code-point order is the form. Very long texts are read whole; runs of any
length count. An empty table, or one without frequent words, gives an empty
result. Columns besides id and text are not read, so their names may clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import batches, documents, id_and_text, stage, texts

LEAST_CODE_POINTS, LEAST_COUNT = 6, 5
#: One in so many runs of a document loses a code point.
DELETED_ONE_IN = 199
RATIO = 5
SHORTEST, LONGEST = 2, 4
LEAST_LIST, MOST_GRAMS = 32, 200_000
#: Words that a task holds before it hands on their counts.
HELD_WORDS = 200_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CODE_POINTS)


def text_words(doc_id: int | None, text: str) -> Counter:
    """Occurrences of the words of a text, with the planted deletions."""
    runs = Counter(_RUN.findall(text.encode().lower().decode()))  # bytes: A-Z alone change case
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    cut = [(r, h) for r in runs if not (h := zlib.crc32(r.encode(), start)) % DELETED_ONE_IN]
    shorter = [(r[:h % len(r)] + r[h % len(r) + 1:], runs.pop(r)) for r, h in cut]
    for r, n in shorter:
        runs[r] += n
    return runs


def _counts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows() -> Iterator[tuple[str, int]]:
        held: Counter = Counter()
        for batch in found:
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                held.update(text_words(i, t))
                if len(held) >= HELD_WORDS:
                    yield from held.items()
                    held = Counter()
        yield from held.items()

    for out in batches(((w, n) for w, n in rows() if len(w) >= LEAST_CODE_POINTS), schema):
        yield out


def words(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): every word and its occurrences in all documents."""
    return docs.select(*id_and_text(docs)).mapInArrow(_counts, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def frequent_grams(words_: DataFrame, most: int = MOST_GRAMS, least_list: int = LEAST_LIST) -> dict[str, int]:
    """The grams that are expanded, with their occurrences; at most ``most``."""
    place = words_.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word") - (SHORTEST - 1))).alias("p"))
    rest = F.char_length("word") - F.col("p") + 1
    grams = place.select(F.explode(F.filter(F.array(*[
        F.when(rest >= k, F.substring("word", F.col("p"), F.lit(k))) for k in range(SHORTEST, LONGEST)]),
        lambda g: g.isNotNull())).alias("gram"))
    places = words_.agg(F.sum(F.char_length("word"))).first()[0] or 0
    # all lists together are shorter than places * lengths, so fewer than
    # ``most`` of them are longer than the threshold
    threshold = max(least_list, -(-places * (LONGEST - SHORTEST) // most))
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > threshold)
    return {r.gram: r.n for r in found.collect()}


def decompose(word: str, longest: int, frequent: dict[str, int]) -> list[str]:
    """The gram at every place of a word."""
    n, out = len(word), []
    for p in range(n - SHORTEST + 1):
        k = SHORTEST
        while k < longest and p + k < n and word[p:p + k] in frequent:
            k += 1
        out.append(word[p:p + k])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can change: those over one place. A gram
    that ends with the word and would grow also covers its last place, so an
    insertion at the end changes no more."""
    covers = np.zeros(len(grams) + SHORTEST, np.int64)
    for p, g in enumerate(grams):
        covers[p] += 1
        covers[p + len(g)] -= 1
    return int(np.cumsum(covers).max())


@lru_cache(1 << 17)
def _token(place: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{place}\0{gram}")


def list_keys(grams: list[str], n: int, longest: int, frequent: dict[str, int], gap: bool, shift: int) -> set[int]:
    """A key per place of an edit: the sum of the hashes of the grams that it
    leaves unaffected, with their places. ``gap``: the edit is an addition
    before the place (of 0..n), else a change of the code point at the place.
    Grams behind it count ``shift`` places further."""
    left, right = [0] * (n + 2), [0] * (n + 2)
    for p, g in enumerate(grams):
        end = p + len(g)
        if gap and end == n and len(g) < longest and g in frequent:
            end += 1        # would grow with a code point added at the end
        left[end] += _token(p, g)
        right[p] += _token(p + shift, g)
    for i in range(n + 1):
        left[i + 1] += left[i]
        right[n - i] += right[n - i + 1]
    return {(left[i] + right[i if gap else i + 1]) & 0xFFFFFFFFFFFFFFFF for i in range(n + gap)}


INDEX_SQL = "key long, side int, word string"


def index_rows(word: str, frequent: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(key, side) of the lists a word stands in. Side 0 is compared with its
    like; side 1 (shorter) with side 2 (longer by one)."""
    n = len(word)
    for family in (n, n - 1):
        if family < LEAST_CODE_POINTS:
            continue
        longest = min(LONGEST, family // 2)
        grams = decompose(word, longest, frequent)
        sides = ((0, False, 0), (1, True, 1)) if family == n else ((2, False, 0),)
        for side, gap, shift in sides:
            kind = _token(family, f"side {min(side, 1)}")
            for key in list_keys(grams, n, longest, frequent, gap, shift):
                yield ((key + kind) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), side


def _index(shared: object) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in found:
            for a in range(0, batch.num_rows, 5000):
                rows = [(*r, w) for w in batch.column(0).slice(a, 5000).to_pylist() for r in index_rows(w, frequent)]
                keys, sides, words_ = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(sides, pa.int32()), pa.array(words_, pa.string())],
                    names=["key", "side", "word"])
    return run


def near(words_: DataFrame) -> DataFrame:
    """(a, b): all pairs of words one edit apart, each once. ``words_`` has
    one row per word, of ``LEAST_CODE_POINTS`` code points or more."""
    spark = words_.sparkSession
    shared = spark.sparkContext.broadcast(frequent_grams(words_))
    lists = stage(words_.select("word").mapInArrow(_index(shared), INDEX_SQL), "lists")
    x = lists.filter("side < 2").select("key", F.col("word").alias("a"), "side")
    y = lists.filter("side <> 1").select("key", F.col("word").alias("b"), F.col("side").alias("to"))
    met = x.join(y, "key").filter("(side = 0 and to = 0 and a < b) or (side = 1 and to = 2)")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each (word, form): forms are followed to the end. The
    count grows along forms, so there is no circle; each round doubles the
    steps taken."""
    held = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stage(held.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        held = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return held


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of (word, n): its near words, form and root."""
    counted = stage(counted, "words")
    pairs = stage(near(counted), "near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    count = counted.select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    best = both.join(count, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    named = counted.join(best, "word", "left").withColumn("n_best", -F.col("best.less"))
    stands = F.col("n_best") >= ratio * F.col("n")
    rows = stage(named.select("word", F.when(stands, F.col("best.other")).alias("form"), "n",
                              F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(stands, F.col("n_best")).alias("form_n")), "forms")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(documents(spark, sf_dir)))
