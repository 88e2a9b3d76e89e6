"""Positions, selections and digests over a whole order, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends there, and it is computed once."""
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``pos`` (from 0) and ``members`` of each group, in ascending order of columns, nulls first.

    Rows are dealt by ranges of group and order, written, and counted by (group, part); running sums of those counts, a row for each
    part, give every part its first position. A group with most of the rows is spread over many parts. Equal rows are told
    apart by where they were read, so that a border can fall between them.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_read")]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    placed = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).drop("_read"), "ordered")
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy(group)
    parts = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_in"), (F.col("_first") - F.sum("_n").over(by.orderBy("_part")) + F.col("_n")).alias("_lead"),
        F.sum("_n").over(by).alias("members"),
    )
    found = placed.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return found.withColumn("pos", F.col("_at") - F.col("_lead")).drop("_group", "_in", "_lead", "_part", "_at")


def smallest(rows: DataFrame, count: int, key: Column, digits: int = 3) -> tuple[DataFrame, Column | None]:
    """The ``count`` rows with the smallest hexadecimal keys, and the condition on the key that picks them (null: all rows).

    Counting by the next few digits finds the digits of the last row that is wanted, at most 16 ** digits counts at a time; then it is a
    filter. Rows that repeat the last row's whole key come along.
    """
    if count <= 0:
        return rows.filter(F.lit(False)), F.lit(False)
    prefix, need = "", count
    while True:
        left = rows.select(key.alias("k")).filter(F.startswith("k", F.lit(prefix)))
        bins = sorted(left.groupBy(F.substring("k", len(prefix) + 1, digits).alias("d")).count().collect())
        for digit, many in bins:
            if many >= need:
                break
            need -= many
        else:
            return rows, None  # fewer rows than wanted; later rounds never end here
        prefix += digit
        if many == need or not digit or len(digit) < digits:
            picked = key < F.lit(prefix + "~")  # above all keys with these digits
            return rows.filter(picked), picked


def tree_digest(rows: DataFrame, group: str, order: str, value: str, fan: int = 1024) -> DataFrame:
    """One digest for each group of ordered texts: (group, members, digest).

    Runs of ``fan`` texts, joined by line ends, are hashed; runs of ``fan`` digests are hashed the same way until one is left. A group of at
    most ``fan`` texts therefore has the plain digest of its joined texts, and no task ever holds more than ``fan`` texts.
    """
    nodes = numbered(rows.select(group, order, F.col(value).alias("_text")), group, order).select(group, "pos", "members", "_text")
    nodes = nodes.withColumn("_left", F.col("members"))
    while True:
        runs = nodes.groupBy(group, "members", "_left", F.floor(F.col("pos") / fan).alias("pos"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda item: item["_text"])
        nodes = written(runs.agg(F.sha2(F.array_join(ordered, "\n", ""), 256).alias("_text")), "digests")
        nodes = nodes.withColumn("_left", F.ceil(F.col("_left") / fan))
        if not nodes.filter(F.col("_left") > 1).limit(1).count():
            return nodes.select(group, "members", F.col("_text").alias("digest"))
