"""Exact histogram of encoded lengths and what it answers for every limit.

Each task encodes its whole texts and keeps one counter per length; the
counters are summed by length, and running sums over the distinct lengths
give, for every context limit that is itself a length, totals, quantiles and
truncated totals. :func:`at_limit` and :func:`quantile` answer for any limit
or share from the same rows.

Defined cases: a null or empty text has length 1 (the end id). Ids are not
read, so null and repeated ids count as rows like any other. An empty table
gives an empty histogram, for which totals are 0 and quantiles null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import tokens
from llm.common import batches, documents, id_and_text, offsets, partitions, stage, texts


def _count(path: str):
    schema = pa.schema([("length", pa.int64()), ("n_docs", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]):
        encode = tokens.Encoder(path)
        counts: Counter[int] = Counter()
        for batch in found:
            counts.update(len(ids) // 4 for ids in encode(texts(batch.column(0))))
        if counts:
            yield from batches(counts.items(), schema)

    return run


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents."""
    text = docs.select(id_and_text(docs)[1])
    return (text.mapInArrow(_count(path or tokens.tokenizer_path()), "length long, n_docs long")
            .groupBy("length").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length L: documents and tokens of documents of at least L,
    the share of documents of at most L, how many documents a limit of L cuts
    and what it keeps of all tokens."""
    d = offsets(hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")),
                ["length"], ["n_docs", "n_tokens"], partitions(hist.sparkSession))
    total = hist.agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t")).first()
    docs, toks = total.d or 0, total.t or 0
    longer = F.lit(docs) - F.col("n_docs_before") - F.col("n_docs")
    return d.select(
        "length", "n_docs", "n_tokens",
        (F.lit(docs) - F.col("n_docs_before")).alias("docs_from"),
        (F.lit(toks) - F.col("n_tokens_before")).alias("tokens_from"),
        ((F.col("n_docs_before") + F.col("n_docs")) / F.lit(docs)).alias("share_up_to"),
        longer.alias("docs_cut"),
        (F.col("n_tokens_before") + F.col("n_tokens") + longer * F.col("length")).alias("tokens_kept"))


def at_limit(sums: DataFrame, limit: int) -> dict[str, int]:
    """Totals under any context limit: documents cut, tokens kept and lost."""
    r = sums.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("cut"),
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("kept")).first()
    return {"docs_cut": r.cut, "tokens_kept": r.kept, "tokens_lost": r["all"] - r.kept}


def quantile(sums: DataFrame, share: float) -> int | None:
    """Least length that at least ``share`` of the documents do not exceed."""
    return sums.filter(F.col("share_up_to") >= share).agg(F.min("length").alias("q")).first().q


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(stage(histogram(documents(spark, sf_dir)), "lengths"))
