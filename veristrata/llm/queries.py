"""Registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, jaccard_join, language_id, license_scan, lm_scoring, mixing, packing, prefix_trie, quality_crf, quality_rules, source_audit, topk_search, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _with_labels(op: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": _with_labels(quality_crf.op1),
    "op2_packing": _over("documents", packing.op2),
    "op3_topk_search": _over("embeddings", topk_search.op3),
    "op4_chat_formatting": _over("conversations", chat_format.op4),
    "op5_lm_scoring": _over("documents", lm_scoring.op5),
    "op6_toxicity": _with_labels(toxicity.op6),
    "op7_language_id": _over("documents", language_id.op7),
    "op8_jaccard_join": _over("documents", jaccard_join.op8),
    "op9_quality_rules": _over("documents", quality_rules.op9),
    "op10_mixing": _over("documents", mixing.op10),
    "op11_source_audit": _over("documents", source_audit.op11),
    "op12_prefix_trie": _over("conversations", prefix_trie.op12),
    "op13_license_scan": _over("documents", license_scan.op13),
}

ORACLES: dict[str, str] = {
    "op3_topk_search": topk_search.SQL,
    "op4_chat_formatting": chat_format.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op10_mixing": mixing.SQL,
    "op11_source_audit": source_audit.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_license_scan": license_scan.SQL,
}
