"""Corpus pipeline over ``documents``, stage by stage.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs,
sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads
again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``, whatever they are: columns besides doc_id and text
pass through, also with names that an operator uses itself.

* ``toxicity``: trains on the labels of the documents at hand and drops those
  the classifier rejects (score of at least 0.5). Null and empty texts have no
  word and are kept; texts with null or repeated ids are scored row by row
  (such rows train nothing), so equal texts share one fate; very long texts
  are scored whole. Without labels no text is rejected.
* ``near_dedup``: keeps one document of each near-duplicate group (sets of
  5-word shingles, similarity 0.8 or more), the one of least id; of rows with
  that id the first by file and place. Null ids come last. Null texts and
  texts without words are no copies and all kept; very long texts are read
  whole.
* ``decontaminate``: drops documents with a benchmark window. Null texts and
  texts without words are kept; rows are judged one by one, whatever their
  id; very long texts are read whole; without a benchmark nothing is dropped.
* ``secrets``: replaces the secret part of every span; ``n_chars`` follows.
  Keeps every row; null texts stay null and empty ones empty; equal texts
  change alike; of spans that overlap the earliest, longest is replaced.
* ``packing``: packs the rest into sequences; one row per piece. A null or
  empty text is its end id alone; rows of equal or null ids are packed one by
  one, in the order :mod:`llm.packing` states; very long texts are cut into
  pieces.

An empty table gives an empty table of the same columns in every stage.
Part of the document operators: the driver may remove this file with them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, near_dedup, packing, secrets, toxicity
from llm.common import ROW_KEY, bounded_batches, documents, stage, with_row_key

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5
#: Row keys that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    classifier = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    name = "_toxicity"
    return toxicity.with_score(docs, classifier, out=name).filter(F.col(name) < 0.5).drop(name)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs``, written out once if its rows have no place in a file: the
    operator and the drop must see the same row keys."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018  resolves the metadata columns
        return docs
    except AnalysisException:
        names = [f"c{i}" for i in range(len(docs.columns))]  # names may repeat
        return stage(docs.toDF(*names), "placed").toDF(*docs.columns)


def _drop(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose row key is not in ``keys``; few keys are sent to
    every task, more are joined by a shuffle."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # no clash with the key
    rows = with_row_key(docs.toDF(*names), *names)
    keys = stage(keys, "dropped")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return rows.join(keys, ROW_KEY, "left_anti").select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = _placed(docs)
    found = near_dedup.NearDuplicates(docs, SHINGLE).result()
    return _drop(docs, found.filter("not first").select(*ROW_KEY))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = _placed(docs)
    found = decontaminate.contaminated(docs, documents(spark, sf_dir, "benchmark"))
    return _drop(docs, found.filter("n_hit > 0").select(*ROW_KEY))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.redact(docs, secrets.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier, the MinHash groups and the packing are not expressible in
#: SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
