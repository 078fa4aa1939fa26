"""Corpus pipeline: quality classifier, language ID, near duplicates, mixing, packing.

Every stage takes what its predecessor kept and returns the columns of ``documents``;
the last returns packed pieces.  Null, empty, repeated and clashing rows follow the
docstring of each stage's operator; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristrata.llm import jaccard_join, language_id, mixing, packing, quality_crf
from veristrata.llm.storage import persist


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier calls good; labels are learned from ``labels``."""
    return quality_crf.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified main language."""
    return language_id.identified_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; documents of repeated sources come more than once."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

#: The learned stages and the tokenizer cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
