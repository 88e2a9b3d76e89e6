"""Streaming checks: each job runs over the event table as a stream and is compared with plain SQL.

Events are delivered in five parts of six days. Where a job allows it, every fifth event comes one part late and every third comes again
with the next part. Each job runs delivery by delivery and once over all files; both must give the rows of the SQL. A delivery of a few rows
is one file; a larger one is several, and a trigger then takes as many as a delivery has on average.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from ..streaming import jobs
from . import bindings as b
from .registry import check

_START, _PARTS, _DAYS = "2024-01-01", 5, 6
_TRIGGERS = "(VALUES ('by file'), ('all files')) AS runs(run)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select(
        b.org_of("user_id").alias("org"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("event_id").cast("bigint").alias("_number"),
    )


def _deliver(rows: DataFrame, label: str, late: bool = False, repeats: bool = False, closing: DataFrame | None = None) -> str:
    """Folder of delivered files; the rows of a company in one part lie in one file."""
    folder = fresh_folder(rows.sparkSession, label)
    part = F.least(F.floor(F.datediff("ts", F.lit(_START)) / _DAYS), F.lit(_PARTS - 1)).cast("int")
    if late:
        part = part + F.when(F.col("_number") % 5 == 0, 1).otherwise(0)
    sent = rows.withColumn("_part", part)
    for number in range(_PARTS + 2):
        now = F.col("_part") == number
        if repeats:
            now = now | ((F.col("_part") == number - 1) & (F.col("_number") % 3 == 0))
        sent.filter(now).drop("_part", "_number").repartition("org").write.mode("append").parquet(folder)
    if closing is not None:
        closing.write.mode("append").parquet(folder)
    return folder


def _both_runs(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    schema = spark.read.parquet(folder).schema
    files = len(spark.read.parquet(folder).inputFiles())
    by_file = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // (_PARTS + 2)))).parquet(folder)
    at_once = spark.readStream.schema(schema).parquet(folder)
    return job(by_file).withColumn("run", F.lit("by file")).unionByName(job(at_once).withColumn("run", F.lit("all files")))


@check(
    "T1_deduplicated_stream",
    sql=f"SELECT CAST(800000000 + user_id AS VARCHAR) AS org, CAST(event_id AS VARCHAR) AS event_id, run FROM events, {_TRIGGERS}",
)
def deduplicated_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("org", "event_id", "ts", "_number")
    folder = _deliver(rows.unionByName(rows), "delivered", late=True, repeats=True)

    def job(stream: DataFrame) -> DataFrame:
        events = stream.withColumnRenamed("ts", "dato")
        return jobs.run_available(jobs.deduplicated_events(events, "20 days"), "dedup").select("org", "event_id")

    return _both_runs(spark, folder, job)


@check(
    "T2_newest_events_stream",
    sql=f"""SELECT org, event_id, run FROM (SELECT CAST(800000000 + user_id AS VARCHAR) AS org, CAST(event_id AS VARCHAR) AS event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ') DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events), {_TRIGGERS}
      WHERE rn <= 3""",
)
def newest_events_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = _deliver(_events(spark, d), "delivered", late=True, repeats=True)

    def job(stream: DataFrame) -> DataFrame:
        events = stream.select(
            "org", "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effective_at"), F.col("event_type").alias("summary")
        )
        return jobs.run_available(events, "newest", each=jobs.newest_events).select("org", "event_id")

    return _both_runs(spark, folder, job)


@check(
    "T3_refresh_stream",
    sql=f"""WITH v AS (SELECT user_id, event_type, ts, json_extract_string(props, '$.k') AS value FROM events),
      steps AS (SELECT *, lag(value) OVER w AS before, row_number() OVER w AS n FROM v
        WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, value NULLS FIRST))
      SELECT CAST(800000000 + user_id AS VARCHAR) AS org, event_type AS field, before AS previous_value, value AS current_value, run
      FROM steps, {_TRIGGERS} WHERE n > 1 AND value IS DISTINCT FROM before""",
)
def refresh_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = _deliver(_events(spark, d), "delivered", late=True, repeats=True)

    def job(stream: DataFrame) -> DataFrame:
        observed = stream.select(
            "org", F.col("event_type").alias("field"), F.col("k").alias("value"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("retrieved_at"),
        )
        histories = jobs.run_available(jobs.refresh_histories(observed), "refresh", mode="update", keys=["org", "field"])
        return histories.select("org", "field", F.inline("changes")).select("org", "field", "previous_value", "current_value")

    return _both_runs(spark, folder, job)


@check(
    "T4_daily_ledger_stream",
    sql=f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS platform, 'ok' AS status, count(*) AS events, run
      FROM events, {_TRIGGERS} GROUP BY ALL""",
)
def daily_ledger_stream(spark: SparkSession, d: str) -> DataFrame:
    """A last delivery long after the others lets the watermark pass their days; its own day stays open."""
    rows = _events(spark, d).select("org", "ts", "event_type", "_number")
    closing = spark.range(1).select(
        F.lit("800000000").alias("org"), F.lit("2024-06-01").cast("timestamp").alias("ts"), F.lit("closing").alias("event_type")
    )
    folder = _deliver(rows, "delivered", late=True, closing=closing)

    def job(stream: DataFrame) -> DataFrame:
        events = stream.select(F.col("ts").alias("retrieved_at"), F.col("event_type").alias("platform"), F.lit("ok").alias("status"))
        ledger = jobs.run_available(jobs.daily_ledger(events, "20 days"), "ledger")
        return ledger.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "platform", "status", "events")

    return _both_runs(spark, folder, job)
