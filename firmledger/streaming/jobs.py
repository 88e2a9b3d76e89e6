"""Event, diff and ledger jobs on streams.

Results do not depend on how files are dealt to micro-batches: state holds what later batches need, and update-mode output is
read with the last batch of every key. A trigger's size is bounded by the source (``maxFilesPerTrigger``).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.staging import bound
from ..session import fresh_folder


# --- T1: deduplicated change events -----------------------------------------------------------------

def deduplicated_events(events: DataFrame, tolerance: str = "1 day") -> DataFrame:
    """Each (org, event_id) once, as long as its repeats arrive within the tolerance. ``events`` holds a time ``dato``."""
    return events.withWatermark("dato", tolerance).dropDuplicatesWithinWatermark(["org", "event_id"])


# --- T2: newest events per company --------------------------------------------------------------------

def newest_events(events: DataFrame, count: int = 3) -> DataFrame:
    """The newest events of each company in a table or in one micro-batch; an event that was delivered again counts once, in its newest form.

    The newest of all rows are the newest among those of their parts, so a trigger keeps its own only and
    ``run_available(..., each=newest_events)`` takes the newest of what the triggers wrote. A company with a third of all events
    sends ``count`` rows per task to the ranking.
    """
    latest = events.groupBy("org", "event_id").agg(F.max(F.struct("effective_at", "summary")).alias("_latest"))
    rows = latest.select("org", "event_id", "_latest.*")
    rank = F.row_number().over(Window.partitionBy("org").orderBy(F.desc("effective_at"), F.desc("event_id")))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= count).drop("_rank")


# --- T3: refresh diff -----------------------------------------------------------------------------------

_CHANGE = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("org", "field", "previous_value", "current_value", "retrieved_at")]
    + [T.StructField("retracted", T.BooleanType())]
)


def refresh_changes(values: DataFrame, horizon: timedelta | None = None) -> DataFrame:
    """A change whenever a value of a (company, field) differs from the one before it in time; equal values are no change.

    ``values``: org, field, value, retrieved_at (ISO text). The first value of a key is no change; values without a time are passed over.
    Values may arrive in any order: state holds the seen values of a key in the order of time, and one that falls between two others
    takes back the change between them (``retracted``) and states the two that replace it. :func:`settled_changes` gives what holds in the end,
    which is the same however the values were dealt to triggers. Repeats change nothing.

    With a ``horizon``, values older than the newest one by more than that are forgotten but for the last of them, and what arrives
    before that one is passed over; without it, nothing is ever too late and a key's state grows with its values.
    """
    names = ["org", "field", "value", "retrieved_at"]
    kept_schema = T.StructType([T.StructField(name, T.StringType()) for name in names])

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[names].drop_duplicates()

    def changes(places: list[list]) -> Counter:
        # A place is (time, whether there is a value, value): null comes first among values of one time.
        return Counter((a[2] if a[1] else None, b[2] if b[1] else None, b[0]) for a, b in pairwise(places) if a[1:] != b[1:])

    def update(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = {
            (seen_at, not pd.isna(value), "" if pd.isna(value) else value)
            for batch in batches
            for seen_at, value in batch[["retrieved_at", "value"]].itertuples(index=False, name=None)
        }
        old = [tuple(place) for place in json.loads(state.get[0])] if state.exists else []
        forgetful = horizon is not None and state.exists and state.get[1]
        places = sorted({*old, *(place for place in new if not forgetful or place >= old[0])})
        before, after = changes(old), changes(places)
        rows = [(*key, *change, False) for change in (after - before).elements()] + [(*key, *change, True) for change in (before - after).elements()]
        if horizon is not None and places:
            least = (datetime.fromisoformat(places[-1][0]) - horizon).isoformat()
            first = max((k for k, place in enumerate(places) if place[0] < least), default=0)
            places, forgetful = places[first:], forgetful or first > 0
        state.update((json.dumps(places), bool(forgetful)))
        if rows:
            yield pd.DataFrame(rows, columns=_CHANGE.fieldNames())

    return (
        values.select(*names)
        .filter(F.col("retrieved_at").isNotNull())
        .mapInPandas(shrink, kept_schema)
        .groupBy("org", "field")
        .applyInPandasWithState(update, _CHANGE, "places STRING, forgetful BOOLEAN", "append", GroupStateTimeout.NoTimeout)
    )


def refresh_histories(values: DataFrame) -> DataFrame:
    """The changes of :func:`refresh_changes` without a horizon, in update mode: org, field, changes.

    A (company, field) that got a value states all its changes anew; they replace its earlier ones, so nothing is taken back. State
    is the set of seen values of a key, kept by the engine's own aggregation: no key costs a call of Python.
    Read it with ``run_available(..., keys=["org", "field"])`` and take the changes apart afterwards.
    """
    place = F.struct("retrieved_at", F.col("value").isNotNull().alias("given"), "value")
    seen = values.filter(F.col("retrieved_at").isNotNull()).groupBy("org", "field").agg(F.sort_array(F.collect_set(place)).alias("places"))

    def changes(places: Column) -> Column:
        steps = F.zip_with(
            F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1),
            lambda a, b: F.struct(a.value.alias("previous_value"), b.value.alias("current_value"), b.retrieved_at.alias("retrieved_at")),
        )
        return F.filter(steps, lambda step: ~step.previous_value.eqNullSafe(step.current_value))

    return seen.select("org", "field", bound(F.col("places"), changes).alias("changes"))


def settled_changes(stated: DataFrame) -> DataFrame:
    """Changes that were stated and not taken back."""
    kept = [name for name in _CHANGE.fieldNames() if name != "retracted"]
    counted = stated.groupBy(*kept).agg(F.sum(F.when(F.col("retracted"), -1).otherwise(1)).alias("_n"))
    return counted.filter(F.col("_n") > 0).select(*kept)


# --- T4: crawl ledger --------------------------------------------------------------------------------------

def daily_ledger(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events per day, platform and status, in append mode.

    A day is written once, when the watermark has passed its end, and its state is dropped then. Rows that come later than
    the watermark allows are dropped and counted by the engine; days that are still open are not written.
    """
    return (
        events.withWatermark("retrieved_at", watermark)
        .groupBy(F.window("retrieved_at", "1 day"), "platform", "status")
        .agg(F.count(F.lit(1)).alias("events"))
    )


# --- running ------------------------------------------------------------------------------------------------

def run_available(
    stream: DataFrame, label: str, mode: str = "append", keys: list[str] | None = None, each: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run a stream over what is there and return what it wrote.

    Output and checkpoint lie in the shared folder. Results are written per batch under the batch id, so a batch that runs
    again after a failure overwrites itself. In update mode a later batch replaces the rows of its ``keys``.
    ``each`` reduces every batch to rows of the same columns and, in the end, the rows of all batches together.
    """
    if mode != "append" and not keys:
        raise ValueError("update mode needs the keys whose rows a later batch replaces")
    spark = stream.sparkSession
    folder = fresh_folder(spark, label)
    output, state = f"{folder}/out", f"{folder}/state"

    def write(rows: DataFrame, batch_id: int) -> None:
        kept = each(rows) if each else rows
        kept.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    write(spark.createDataFrame([], stream.schema), -1)  # a source without rows has an empty result
    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    query: StreamingQuery = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(output)
    if mode != "append":
        last = F.max("batch").over(Window.partitionBy(*keys))
        rows = rows.withColumn("_last", last).filter(F.col("batch") == F.col("_last")).drop("_last")
    rows = rows.drop("batch")
    return each(rows) if each else rows
