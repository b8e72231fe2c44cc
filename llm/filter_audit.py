"""Interaction audit of document filters over every order of applying them.

A document is reduced to the mask of the filters it fails. In an order of the
filters it is removed at the first of them that it fails, so which orders
remove it at step k depends on the mask alone: they are the orders that start
with k - 1 letters outside the mask and go on with one of its letters. Orders
are numbered by their Lehmer code (lexicographic rank), which makes the orders
with a common beginning one interval of ranks. :func:`intervals` lists, per
mask and step, these intervals; counts are added at their first rank and taken
off after their last, and one running sum over the ranks gives the rows
removed at every step of every order. No document meets an order, and no order
is walked.

The table of intervals has a few hundred rows and depends on the number of
filters only; the counts have one row per part and mask.

Filter E ("the text of a smaller id") needs the whole table: rows are counted
by (text digest, part, labels) together with the least id and the rows that
have it, so a text that fills a third of the table is a handful of rows before
its digest is brought together.

Defined cases: a null text counts as empty, a null source as the empty part.
A row without id has no smaller id, fails no E and has no label; rows of one
repeated id are counted one by one, and those of the least id of a text all
pass E. A document is good or toxic if any of its label rows says so; null
labels say nothing. Very long texts are read whole. An empty table gives an
empty result. Columns besides id, text and source are not read, so their names
may clash with the operator's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.common import documents, id_and_text, texts

#: One letter per filter; E is the repeated text.
LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")

_SYMBOL = re.compile(rb"[#$%&*|]")
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_COUNTS = ["n", "good", "toxic"]


def text_mask(text: str) -> int:
    """The filters A to D that a text fails, one bit each."""
    raw = text.encode()
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    fails = (len(words) < 50,
             100 * len(set(words)) < 65 * len(words),
             100 * len(raw.translate(None, _NOT_CAPITAL)) > 5 * len(text),
             _SYMBOL.search(raw) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


def _masked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in found:
        for a in range(0, big.num_rows, 1000):
            batch = big.slice(a, 1000)
            held = texts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(text_mask, held), pa.int32()),
                 pa.array([hashlib.sha256(t.encode()).digest() for t in held], pa.binary())],
                names=["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame, labels: DataFrame, source_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail."""
    doc_id, text = id_and_text(docs)
    rows = docs.select(doc_id, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), text) \
        .mapInArrow(_masked, "doc_id long, part string, mask int, digest binary") \
        .groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[
        F.coalesce(F.col(c) == 1, F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]) \
        .filter("good or toxic").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    labelled = rows.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    # per text, part and labels: all rows, rows without id, the least id and its rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    by_text = labelled.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        first.alias("first"))
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    first_rows = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    judged = by_text.withColumn("least", least).withColumn("passing", F.col("no_id") + first_rows)
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                   F.struct((F.col("mask") + REPEATED).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    found = judged.select("part", "good", "toxic", F.explode(both).alias("x"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).cast("long").alias(c)
    return found.filter("x.n > 0").groupBy("part", "x.mask").agg(
        F.sum("x.n").cast("long").alias("n"), count("good"), count("toxic"))


def rank(order: tuple[int, ...], letters: int) -> int:
    """Lexicographic rank of the first order of all ``letters`` filters that
    begins with ``order``: its Lehmer code in the factorial number system."""
    left, found = list(range(letters)), 0
    for i, x in enumerate(order):
        found += left.index(x) * factorial(letters - 1 - i)
        left.remove(x)
    return found


def intervals(letters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove
    a document failing exactly ``mask`` at ``step``; touching ones are joined."""
    found = []
    for mask in range(1, 1 << letters):
        inside = [i for i in range(letters) if mask >> i & 1]
        outside = [i for i in range(letters) if not mask >> i & 1]
        for step in range(1, len(outside) + 2):
            held: list[list[int]] = []
            for first in sorted(rank((*before, x), letters)
                                for before in permutations(outside, step - 1) for x in inside):
                if held and held[-1][1] == first:
                    held[-1][1] += factorial(letters - step)
                else:
                    held.append([first, first + factorial(letters - step)])
            found += [(mask, step, a, b) for a, b in held]
    return found


def orders(letters: str) -> list[tuple[int, str, int, str]]:
    """(rank, order, step, filter) of every order of the letters."""
    return [(r, "".join(o), k + 1, x) for r, o in enumerate(permutations(letters)) for k, x in enumerate(o)]


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Rows removed, kept and spared per part, order and step, from the counts
    of :func:`failures`. ``letters`` must be in ascending order."""
    spark, n = counts.sparkSession, len(letters)
    ends = spark.createDataFrame(intervals(n), "mask int, step int, a int, b int")
    add = lambda at, sign: F.struct(F.col(at).alias("rank"), *[(F.col(c) * sign).alias(c) for c in _COUNTS])
    # a few hundred rows, whatever the tables hold
    steps = counts.join(F.broadcast(ends), "mask").select(
        "part", "step", F.explode(F.array(add("a", 1), add("b", -1))).alias("x"))
    deltas = steps.select("part", "step", "x.*").filter(F.col("rank") < factorial(n))
    parts = counts.select("part").distinct()
    zeros = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(n) - 1))).alias("rank"),
        *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    summed = deltas.unionByName(zeros).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    along = W.partitionBy("part", "step").orderBy("rank")
    named = spark.createDataFrame(orders(letters), "rank int, filter_order string, step int, filter string")
    removed = summed.select("part", "step", "rank", *[F.sum(c).over(along).cast("long").alias(c) for c in _COUNTS]) \
        .join(F.broadcast(named), ["rank", "step"])
    bit = F.explode(F.array(*[F.struct(F.lit(x).alias("filter"), F.lit(1 << i).alias("bit"))
                              for i, x in enumerate(letters)])).alias("f")
    fails = F.col("mask").bitwiseAND(F.col("f.bit")) > 0
    given = lambda test, name: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    whole = counts.select("part", "mask", "n", bit).groupBy("part", F.col("f.filter").alias("filter")).agg(
        F.sum("n").alias("total"), given(fails, "failing"), given(F.col("mask") == F.col("f.bit"), "unique_fails"))
    gone = F.sum("n").over(W.partitionBy("part", "rank").orderBy("step"))
    shapley = F.sum("n").over(W.partitionBy("part", "filter"))
    return removed.join(whole, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), F.col("n").alias("removed"),
        (F.col("failing") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), shapley.alias("shapley"))


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit(failures(documents(spark, sf_dir), documents(spark, sf_dir, "labels")))
    return found.select("part", "filter_order", "step", *map(_long, (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")))
