"""Registered queries of the training-data operators: name -> (spark, table folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (decontamination, html_tree, line_dedup, lm_trie, merkle, packing, quality_rules, simhash, substring_dedup, suffix_repeats, token_counts, token_shards,
                           word_runs)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_tree": lambda spark, sf_dir: html_tree.extract(_read(spark, sf_dir, "pages")),
    "op2_suffix_repeats": _over_documents(suffix_repeats.dedup),
    "op3_decontamination": lambda spark, sf_dir: decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")),
    "op4_line_dedup": _over_documents(line_dedup.report),
    "op5_simhash": _over_documents(simhash.report),
    "op6_lm_trie": _over_documents(lm_trie.score),
    "op7_quality_rules": _over_documents(quality_rules.report),
    "op8_packing": _over_documents(packing.pack_documents),
    "op9_substring_dedup": _over_documents(substring_dedup.dedup),
    "op10_token_counts": _over_documents(token_counts.report),
    "op11_word_runs": _over_documents(word_runs.report),
    "op12_merkle_manifest": _over_documents(merkle.manifest),
    "op13_token_shards": _over_documents(token_shards.report),
}
ORACLES: dict[str, str] = {
    "op3_decontamination": decontamination.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op7_quality_rules": quality_rules.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
}
