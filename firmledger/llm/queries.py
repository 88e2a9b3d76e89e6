"""One query per operator over the whole of its table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import benchmark_leaks
from .encode import vocabulary
from .exact_search import ORACLE_SQL as SEARCH_SQL
from .exact_search import nearest
from .licenses import license_notices
from .licenses import oracle_sql as license_sql
from .merkle import merkle_manifest
from .merkle import oracle_sql as merkle_sql
from .near_dups import near_duplicates
from .packing import pack
from .quality_gbt import quality_scores
from .quality_rules import quality_rules
from .token_alignment import alignment
from .token_histogram import token_histogram
from .token_records import token_records
from .tool_calls import ORACLE_SQL as CALLS_SQL
from .tool_calls import linked_conversations
from .warc import warc_round_trip

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through monolithic archives, one member per record, and back."""
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and Jensen-Shannon verdict of all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return license_notices(table(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents in framed record files, read back."""
    return token_records(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op5_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark leaks of all documents."""
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_gradient_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results that all conversations stand for, linked and serialised."""
    return linked_conversations(table(spark, sf_dir, "conversations")).drop("problems")


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with suffix sums for every context limit."""
    return token_histogram(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_histogram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector against all others."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of all documents, aligned, with corpus counts of linked pairs."""
    return alignment(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
    return dict(sorted(found.items(), key=lambda item: int(item[0][2:].split("_")[0])))


def sql() -> dict[str, str]:
    return {"op3_license_notices": license_sql(), "op8_tool_call_linking": CALLS_SQL, "op11_merkle_manifest": merkle_sql(), "op12_histogram_search": SEARCH_SQL}
