"""Derived input tables, written once per application to the shared folder and read from there by every query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import fresh_folder

_FOLDERS: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet copy of a derived table. A lost executor costs nothing: the copy lies in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FOLDERS:
        folder = fresh_folder(spark, name)
        build().write.option("compression", "zstd").parquet(folder)
        _FOLDERS[key] = folder
    return spark.read.parquet(_FOLDERS[key])


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a stored table dealt to all cores where its files are too few, for steps that make many rows of each."""
    least = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least)
