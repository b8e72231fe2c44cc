"""Registered queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.decontaminate import op10_decontaminate
from llm.filter_audit import op11_filter_audit
from llm.language_model import op7_language_model
from llm.length_histogram import op9_length_histogram
from llm.line_dedup import op13_line_dedup
from llm.near_dedup import op6_near_dedup
from llm.oracles import ORACLES
from llm.packing import op8_packing
from llm.quality_rules import op3_quality_rules
from llm.secrets import op5_secrets
from llm.sharding import op1_sharding
from llm.spelling import op12_spelling
from llm.token_files import op4_token_files
from llm.toxicity import op2_toxicity

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_model": op7_language_model,
    "op8_packing": op8_packing,
    "op9_length_histogram": op9_length_histogram,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling": op12_spelling,
    "op13_line_dedup": op13_line_dedup,
}
