"""Queries of this folder and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, language_id, line_dedup, manifest, near_dedup, quality, secrets, spelling, substring_dedup, topk, warc
from .shared import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_warc": warc.op10_warc,
    "op11_exact_topk": topk.op11_exact_topk,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_exact_topk": topk.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
