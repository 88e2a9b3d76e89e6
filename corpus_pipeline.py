"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's rows as Parquet
to the shared folder and reads them again as the next one's documents. The last stage returns packed pieces, the others
documents with their own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firmledger.llm import decontaminate, near_dups, packing, quality_gbt, quality_rules
from firmledger.llm.common import cut, table
from firmledger.llm.encode import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality_gbt.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base or divergence rules."""
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one document of each near-duplicate class."""
    return near_dups.keep(docs)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", decontaminate_docs),
    ("best-fit packing", pack),
]

#: Trees, signatures and vocabularies are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
