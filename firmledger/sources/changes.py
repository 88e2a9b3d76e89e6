"""Registry change-feed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# value stays JSON text: it may be a scalar, a list or an object.
PAGE_SCHEMA = (
    "_embedded STRUCT<oppdaterteEnheter: ARRAY<STRUCT<organisasjonsnummer: STRING, oppdateringsid: STRING, dato: STRING,"
    " endringstype: STRING, endringer: ARRAY<STRUCT<op: STRING, path: STRING, value: STRING>>>>>,"
    " page STRUCT<totalElements: BIGINT>"
)


def read_change_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page file: its path as page id and its payload text."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("page_id"), F.col("value").alias("payload")
    )


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload) to (page_id, body) with the feed schema."""
    return pages.select("page_id", F.from_json("payload", PAGE_SCHEMA).alias("body"))


def page_events(pages: DataFrame) -> DataFrame:
    """One row per event in document order; ``changes`` keeps the raw change array of the event."""
    parsed = parse_pages(pages)
    rows = parsed.select("page_id", F.posexplode("body._embedded.oppdaterteEnheter").alias("position", "event"))
    return rows.select(
        "page_id",
        F.col("position").alias("seq"),
        F.trim(F.coalesce("event.organisasjonsnummer", F.lit(""))).alias("org"),
        F.col("event.oppdateringsid").alias("event_id"),
        F.col("event.dato").alias("dato"),
        F.coalesce("event.endringstype", F.lit("Ukjent")).alias("event_type"),
        F.col("event.endringer").alias("changes"),
    )


def page_integrity(pages: DataFrame) -> DataFrame:
    """Problems per page: no event array, fewer events than announced, an event that is no object, no event id."""
    parsed = parse_pages(pages)
    events = F.col("body._embedded.oppdaterteEnheter")
    announced = F.col("body.page.totalElements")
    problems = F.array_compact(
        F.array(
            F.when(events.isNull(), F.lit("payload lacks the event array")),
            F.when(announced > F.size(events), F.lit("page is truncated")),
            F.when(F.exists(events, lambda event: event.isNull()), F.lit("event is not an object")),
            F.when(
                F.exists(events, lambda event: event.isNotNull() & event["oppdateringsid"].isNull()),
                F.lit("event lacks its id"),
            ),
        )
    )
    return parsed.select("page_id", F.explode(problems).alias("problem"))
