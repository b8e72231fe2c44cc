"""The registered queries on the small tables: SQL where there is some, the
contract's columns everywhere."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from compare import same  # noqa: E402

from llm.catalog import ORACLES, QUERIES  # noqa: E402
from llm.common import documents  # noqa: E402

#: The columns of each query, in order.
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_token_files": "doc_id start n_tokens ids_crc32",
    "op5_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op6_near_dedup": "doc_id n_shingles component_id kept",
    "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_length_histogram": "length n_docs n_tokens docs_from tokens_from share_up_to docs_cut tokens_kept",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_spelling": "word form root n n_near form_n",
    "op13_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    found = con.execute(ORACLES[name])
    same(QUERIES[name](spark, sf_small), [d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_columns_and_rows(spark, sf_small, name):
    found = QUERIES[name](spark, sf_small)
    assert found.columns == COLUMNS[name].split()
    if name not in ("op8_packing", "op9_length_histogram", "op12_spelling"):
        assert found.count() == documents(spark, sf_small).count()


def test_every_query_is_listed():
    assert set(COLUMNS) == set(QUERIES)
