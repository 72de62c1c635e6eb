"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_extract, jaccard, media, packing, quality, secret_scan, substring, suffixes, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_token_store": token_store.op9_token_store,
    "op10_media_columns": media.op10_media_columns,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE,
    "op3_suffix_array_dedup": suffixes.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op10_media_columns": media.ORACLE,
}
