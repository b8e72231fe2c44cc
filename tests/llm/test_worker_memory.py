"""What one step keeps in a Python worker does not stay for the next."""

import os

import pyarrow as pa

from llm import tokens, toxicity


def test_scoring_drops_the_words_that_encoding_keeps(spark):
    rows = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string") \
        .repartition(16).cache()
    rows.count()

    def worker(encode):
        def run(found):
            if encode:
                list(tokens.Encoder()(["words that are kept here"]))
            for _ in found:
                pass
            held = sum(len(w) for _, w in tokens._loaded.values())
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held])], names=["pid", "held"])
        return {r.pid: r.held for r in rows.mapInArrow(run, "pid long, held long").collect()}

    before = worker(True)
    assert min(before.values()) > 0
    scored = toxicity.with_score(rows, toxicity.Classifier({b"some": 1.0}, 0.0))
    assert scored.count() == 64 and scored.filter("score > 0.7").count() == 64
    after = worker(False)
    again = before.keys() & after.keys()
    assert again and min(after[p] for p in again) == 0
