"""Session settings and lineage cutting.

A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is read, never replaced.
Only where it is unset on a local master (tests, a laptop) a fresh local folder is made; on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One hot key may hold a third of all rows: let the optimiser split it in plain joins.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app_name: str = "firmledger", master: str | None = None, **settings: str) -> SparkSession:
    """Return a session with the engine's defaults; keyword settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="firmledger-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared checkpoint folder."""
    return f"{session_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor does not lose the result."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(session_checkpoint_dir(spark))
    return df.checkpoint(eager=False)
