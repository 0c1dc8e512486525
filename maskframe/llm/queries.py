"""The numbered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, infill, language, media, mixing, negatives, ngram_join, packing, pii, quality, secrets, sharding, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_private_data": pii.query,
    "op2_rendezvous_sharding": sharding.query,
    "op3_ngram_jaccard": ngram_join.query,
    "op4_substring_dedup": substrings.query,
    "op5_sequence_packing": packing.query,
    "op6_source_mixing": mixing.query,
    "op7_media_columns": media.query,
    "op8_language_id": language.query,
    "op9_secret_scan": secrets.query,
    "op10_quality_rules": quality.query,
    "op11_exact_dedup": exact.query,
    "op12_hard_negatives": negatives.query,
    "op13_fill_in_middle": infill.query,
}

ORACLE_SQL: dict[str, str] = {"op3_ngram_jaccard": ngram_join.ORACLE, "op4_substring_dedup": substrings.ORACLE, "op6_source_mixing": mixing.ORACLE, "op11_exact_dedup": exact.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_fill_in_middle": infill.ORACLE}
