"""Published snapshots: all tables of one run, or none.

A run writes its tables into a folder of its own. Only when all of them are complete does it write its manifest, which names the tables,
their folders and their row counts; the writer's commit makes the manifest appear whole. Readers take the newest manifest, so a run that
broke off, or is still writing, is not there for them, and a reader keeps the run it has opened while others are published.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_MANIFEST = "table string, folder string, n_rows bigint, schema string"


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """Write the tables of a run and then its manifest; returns the run's folder.

    ``run_id`` orders the runs as text (an ISO time, say). A run that is written again gets another folder, and its manifest replaces the
    first one's place among the runs only when it is complete.
    """
    if not re.fullmatch(r"[\w.:-]+", run_id):
        raise ValueError(f"run id {run_id!r} is no folder name")
    version = f"{run_id.replace(':', '')}_{uuid.uuid4().hex}"
    folder = f"{root.rstrip('/')}/runs/{version}"
    rows = []
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
        found = spark.read.schema(table.schema).parquet(f"{folder}/{name}").count()
        rows.append((name, f"{folder}/{name}", found, table.schema.json()))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{root.rstrip('/')}/manifests/{version}")
    return folder


def published_runs(spark: SparkSession, root: str) -> list[str]:
    """Folders of all complete manifests, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    folders = [str(status.getPath().toString()) for status in system.listStatus(where) if status.isDirectory()]
    done = [f for f in folders if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]
    return sorted(done, key=lambda f: f.rsplit("/", 1)[-1])


def read_published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the newest run, checked against the row counts of its manifest; an error where nothing is published."""
    runs = published_runs(spark, root)
    if not runs:
        raise ValueError(f"no published run in {root}")
    out = {}
    for row in spark.read.schema(_MANIFEST).json(runs[-1]).collect():  # one row per table
        table = spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).parquet(row["folder"])
        if table.count() != row["n_rows"]:
            raise ValueError(f"table {row['table']} of {runs[-1]} is not as it was published")
        out[row["table"]] = table
    return out

