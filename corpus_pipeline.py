"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Every stage takes null and empty texts, null ids, repeated rows and empty tables; the stages' own modules say what comes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, line_dedup, packing, quality_rules, simhash
from plumbline.llm.storage import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many pages of their source repeat; copies of a text are one page."""
    return line_dedup.clean(docs, copies_once=True)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that stand in a benchmark passage."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good),
    ("line_dedup", without_boilerplate),
    ("simhash", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: SQL has neither the fingerprints nor the tokenizer; the stages are tested against plain versions of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
