"""Exact length histogram (operator 9).

Documents are counted by encoded length; everything else is read off the histogram. Suffix sums over the lengths give, for
every context limit that is itself a length, how many documents exceed it, how many ids are kept if each document is
truncated there, and the rank that makes it a quantile. Any other limit lies between two rows, see ``answers``.

The suffix sums run in two levels (within blocks of lengths, then over the block totals), so no task holds the histogram.
Null and empty texts have length 0. Repeated rows count as often as they occur; extra columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import Encoder

#: Lengths per block of the two-level sums.
BLOCK = 1024


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per document: n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"n_tokens": pa.array([len(encoder.encode(t.as_py())) // 4 for t in batch.column(0)], pa.int64())}
            )

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens bigint")


def histogram(counted: DataFrame) -> DataFrame:
    """Rows n_tokens, n_docs from one row per document; combined before the shuffle."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def _suffix(rows: DataFrame, values: dict[str, Column], totals: DataFrame, whole: DataFrame) -> DataFrame:
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(value).over(inside) for name, value in values.items()}).join(totals, "block")
    return rows.crossJoin(F.broadcast(whole))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length L of the histogram, read as a context limit:

    n_docs (of length L), docs_over (longer than L), tokens_total (of the corpus), tokens_truncated (sum of min(length, L)),
    tokens_lost (the rest), quantile (share of documents of length at most L).
    """
    rows = counts.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "ids": F.col("n_tokens") * F.col("n_docs")})
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("ids").alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
    )
    whole = blocks.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    rows = _suffix(rows, {"docs_from": F.col("n_docs"), "tokens_from": F.col("ids")}, totals, whole)
    over = F.col("docs_from") + F.col("docs_later") - F.col("n_docs")
    lost = F.col("tokens_from") + F.col("tokens_later") - F.col("ids") - over * F.col("n_tokens")
    return rows.select(
        "n_tokens",
        "n_docs",
        over.alias("docs_over"),
        F.col("all_tokens").alias("tokens_total"),
        (F.col("all_tokens") - lost).alias("tokens_truncated"),
        lost.alias("tokens_lost"),
        (F.lit(1.0) - over / F.col("all_docs")).alias("quantile"),
    )


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Documents over and ids kept for any context limits: one row per limit, from the greatest length at or below it."""
    at = [
        F.max_by(F.struct("docs_over", "tokens_truncated", "n_tokens"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens")))
        for limit in limits
    ]
    row = sums.agg(*[value.alias(f"at{k}") for k, value in enumerate(at)], F.max(F.struct("tokens_total")).alias("t"), F.sum("n_docs").alias("n"))
    rows = F.array(*[F.struct(F.lit(limit).cast("bigint").alias("limit"), F.col(f"at{k}").alias("at")) for k, limit in enumerate(limits)])
    over = F.coalesce(F.col("r.at.docs_over"), F.col("n"))
    kept = F.coalesce(F.col("r.at.tokens_truncated") + over * (F.col("r.limit") - F.col("r.at.n_tokens")), over * F.col("r.limit"))
    return row.select(F.explode(rows).alias("r"), "n").where("n IS NOT NULL").select("r.limit", over.alias("docs_over"), kept.alias("tokens_kept"))


def token_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    return suffix_sums(histogram(lengths(docs, vocabulary)))
