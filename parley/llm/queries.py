"""The queries that apply the operators of this subpackage to whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and query function of each operator.
OPERATORS = {
    "op1_token_counts": "token_counts",
    "op2_language_id": "language_id",
    "op3_media_columns": "media",
    "op4_histogram_sort": "sharding",
    "op5_jaccard_join": "jaccard_join",
    "op6_best_fit_packing": "packing",
    "op7_secret_scans": "secrets",
    "op8_bpe_codec": "bpe_codec",
    "op9_lm_scores": "backoff_lm",
    "op10_fingerprints": "fingerprints",
    "op11_license_scans": "licenses",
    "op12_conversation_repair": "conversation_repair",
    "op13_embedding_whitening": "whitening",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(import_module(f"parley.llm.{module}"), name) for name, module in OPERATORS.items()}
    return found


def oracle_sql() -> dict[str, str]:
    from parley.llm.licenses import license_sql

    return {"op11_license_scans": license_sql()}
