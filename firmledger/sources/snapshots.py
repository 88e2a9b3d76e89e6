"""Replay of retained responses instead of live fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import variant_json


def replay(requests: DataFrame, snapshot: DataFrame, snapshot_time: str, snapshot_effective_at: str | None = None) -> DataFrame:
    """Responses for (org, module, url) requests from a snapshot table (url, status, body, retrieved_at, effective_at).

    A request that the snapshot does not hold becomes status 0 with an error. The hash is over the canonical body.
    """
    held = snapshot.select(
        "url",
        F.coalesce("status", F.lit(200)).alias("_status"),
        variant_json(F.col("body")).alias("_canonical"),
        F.col("retrieved_at").alias("_retrieved_at"),
        F.col("effective_at").alias("_effective_at"),
    )
    found = F.col("_status").isNotNull()
    return requests.join(held, "url", "left").select(
        "org",
        "module",
        "url",
        F.coalesce("_status", F.lit(0)).alias("status"),
        F.when(F.col("_status") == 200, F.col("_canonical")).alias("body"),
        F.when(found, F.sha2(F.coalesce("_canonical", F.lit("null")), 256)).alias("content_sha256"),
        F.coalesce("_retrieved_at", F.lit(snapshot_time)).alias("retrieved_at"),
        F.coalesce("_effective_at", F.lit(snapshot_effective_at).cast("string")).alias("effective_at"),
        F.when(~found, F.lit("snapshot response missing"))
        .when(F.col("_status") != 200, F.concat(F.lit("HTTP "), F.col("_status").cast("string")))
        .alias("error"),
    )
