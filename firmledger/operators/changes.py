"""Official registry changes: attribution, dedup, newest per company, claims, reach and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_json, material_id
from ..functions.ordering import written
from ..functions.values import change_summary, path_label
from ..model import CLAIM, EVIDENCE, conform

CHANGE_FIELD = "official_registry_change"
CHANGE_SCOPE = (
    "Dated exact-organisation-number register update. This is an official registry change, "
    "not company-authored news, hiring activity, or a social post."
)


def event_time(dato: Column) -> Column:
    return dato.try_cast("timestamp")


def known_changes(changes: Column) -> Column:
    """Changes with a labelled path and a known operation; a removed value is null."""
    labelled = F.transform(
        F.coalesce(changes, F.array().cast("array<struct<op:string,path:string,value:string>>")),
        lambda change: F.struct(
            F.trim(change["path"]).alias("path"),
            path_label(change["path"]).alias("label"),
            F.lower(F.trim(change["op"])).alias("operation"),
            F.when(F.lower(F.trim(change["op"])) != "remove", change["value"]).alias("value"),
        ),
    )
    return F.filter(
        labelled, lambda change: change["label"].isNotNull() & change["operation"].isin("add", "replace", "remove")
    )


def unexpected_orgs(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Events of companies that were never asked for: integrity findings, never attributed to anyone."""
    return events.join(targets.select("org"), "org", "left_anti").groupBy("org").agg(F.count(F.lit(1)).alias("events"))


def event_digest() -> Column:
    """sha256 of the canonical event with its raw changes."""
    raw = F.transform(
        "changes",
        lambda change: F.struct(change["op"].alias("op"), change["path"].alias("path"), change["value"].alias("value")),
    )
    return F.sha2(
        canonical_json(
            {
                "organisasjonsnummer": F.col("org"),
                "oppdateringsid": F.col("event_id"),
                "dato": F.col("dato"),
                "endringstype": F.col("event_type"),
                "endringer": raw,
            }
        ),
        256,
    )


def published_events(events: DataFrame, targets: DataFrame, as_of: str, lookback_days: int = 365) -> DataFrame:
    """Attributed, dated, labelled events of the window (one day of clock tolerance), one row per event id."""
    now = F.lit(as_of).cast("timestamp")
    effective = event_time(F.col("dato"))
    usable = (
        events.join(targets.select("org"), "org", "left_semi")
        .withColumn("effective", effective)
        .filter(
            F.col("event_id").isNotNull()
            & (F.col("effective") >= now - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
            & (F.col("effective") <= now + F.expr("INTERVAL 1 DAY"))
        )
        .withColumn("known", known_changes(F.col("changes")))
        .filter(F.size("known") > 0)
    )
    # The last delivery of an event id wins. max_by combines on the map side, so repeats never pile up in one task.
    last = usable.groupBy("org", "event_id").agg(
        F.max_by(
            F.struct("effective", "dato", "event_type", "changes", "known", "seq"), F.col("seq")
        ).alias("event")
    )
    return last.select("org", "event_id", "event.*").withColumn("content_sha256", event_digest()).select(
        "org",
        "event_id",
        "event_type",
        F.date_format("effective", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effective_at"),
        "content_sha256",
        F.col("known").alias("changes"),
        change_summary(F.col("known")).alias("summary"),
    )


def newest_events(
    events: DataFrame, targets: DataFrame, as_of: str, lookback_days: int = 365, per_company: int = 3
) -> DataFrame:
    """Newest published events per company, by time then id, both descending."""
    newest = Window.partitionBy("org").orderBy(F.col("effective_at").desc(), F.col("event_id").desc())
    return (
        published_events(events, targets, as_of, lookback_days)
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= per_company)
    )


def change_claims(selected: DataFrame, retrieved_at: str, source_url: str) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence of selected registry changes."""
    rows = selected.filter((F.col("summary") != "") & (F.length("content_sha256") == 64)).withColumn(
        "evidence_id",
        material_id("ev-brreg-change-", 20, F.col("org"), F.lit("brreg-change"), F.col("event_id"), F.col("content_sha256")),
    )
    value = canonical_json(
        {
            "event_id": F.col("event_id"),
            "event_type": F.col("event_type"),
            "effective_at": F.col("effective_at"),
            "summary": F.col("summary"),
            "changes": F.col("changes"),
        }
    )
    claims = rows.select(
        "org",
        F.concat(F.lit("60|"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("claim_order"),
        F.lit(CHANGE_FIELD).alias("field"),
        value.alias("value"),
        F.lit("available").alias("availability"),
        F.lit(1.0).alias("confidence"),
        F.array("evidence_id").alias("evidence_ids"),
        F.lit("official_registry_change").alias("signal_type"),
        F.lit(CHANGE_SCOPE).alias("claim_scope"),
    )
    evidence = rows.select(
        "org",
        F.col("evidence_id").alias("id"),
        F.concat(F.lit(source_url), F.col("org")).alias("source_url"),
        F.lit("official").alias("source_class"),
        F.lit(retrieved_at).alias("retrieved_at"),
        "content_sha256",
        F.col("summary").alias("claim_span"),
        "effective_at",
        F.col("event_id").alias("source_row_key"),
    )
    return conform(claims, CLAIM), conform(evidence, EVIDENCE)


def change_reach(events: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """Event counts per target: all, last 365 and 730 days, and the newest event; targets without events stay."""
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    age = now - F.unix_timestamp(event_time(F.col("dato")))
    day = 86_400
    counted = events.groupBy("org").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(age.between(0, 365 * day)).alias("events_last_365_days"),
        F.count_if(age.between(0, 730 * day)).alias("events_last_730_days"),
        F.max(event_time(F.col("dato"))).alias("latest"),
        F.max_by("event_type", F.struct(event_time(F.col("dato")), F.col("event_id"))).alias("latest_update_type"),
    )
    return targets.select("org").join(counted, "org", "left").select(
        "org",
        F.coalesce("events", F.lit(0)).alias("events"),
        (F.coalesce("events", F.lit(0)) > 0).alias("has_history"),
        F.coalesce("events_last_365_days", F.lit(0)).alias("events_last_365_days"),
        F.coalesce("events_last_730_days", F.lit(0)).alias("events_last_730_days"),
        F.date_format("latest", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("latest_update_at"),
        "latest_update_type",
    )


def reach_summary(reach: DataFrame) -> DataFrame:
    """Reach rates over all targets, six decimals."""

    def rate(condition: Column) -> Column:
        return F.round(F.count_if(condition) / F.count(F.lit(1)), 6)

    return reach.agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum("events").alias("events"),
        rate(F.col("has_history")).alias("history_reach_rate"),
        rate(F.col("events_last_365_days") > 0).alias("recent_365_reach_rate"),
        rate(F.col("events_last_730_days") > 0).alias("recent_730_reach_rate"),
    )


def change_paths(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Change counts per company and path as a long table."""
    rows = events.join(targets.select("org"), "org", "left_semi").select("org", F.explode("changes").alias("change"))
    path = F.coalesce(F.nullif(F.trim("change.path"), F.lit("")), F.lit("(unknown)"))
    return rows.groupBy("org", path.alias("path")).agg(F.count(F.lit(1)).alias("changes"))


def top_paths(paths: DataFrame, count: int = 30) -> DataFrame:
    return (
        paths.groupBy("path")
        .agg(F.sum("changes").alias("changes"))
        .orderBy(F.col("changes").desc(), F.col("path"))
        .limit(count)
    )


BUCKETS = 4096


def _with(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which nulls are equal."""
    renamed = other.withColumnsRenamed({key: f"_other_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_other_{key}")) for key in keys]
    return rows.join(renamed, same, how).drop(*[f"_other_{key}" for key in keys])


def _at_ranks(values: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Values at given ranks (from 1) of each key, with the number of values as ``n`` and the largest as ``max_value``.

    ``ranks`` are expressions of ``n``. Each key's range of values is cut into ``BUCKETS`` equal buckets; counts per bucket name the bucket
    that holds a rank, and that bucket is cut again until each holds one value. A key with most of the rows costs counts, not a sort:
    no task ever sees more than a key's buckets. Values are whole numbers or finite doubles.
    """
    known = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    # Equal values are counted before the shuffle.
    counted = written(known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    whole = counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("max_value"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()]))
    state = whole.select(*keys, "n", "max_value", "_low", F.col("max_value").alias("_high"), wanted.alias("_w")).select("*", "_w.*").drop("_w")
    state = written(state, "ranks")
    while state.filter("_low < _high").limit(1).count():
        share = (F.col("_v").cast("double") - F.col("_low").cast("double")) / (F.col("_high").cast("double") - F.col("_low").cast("double"))
        bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))
        ranges = state.groupBy(*keys, "_low", "_high").agg(F.collect_set("name").alias("_names")).filter("_low < _high")
        held = _with(counted, ranges, keys, "inner").filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        bins = held.groupBy(*keys, "_low", "_high", "_names", bucket.alias("_b")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_low", "_high").orderBy("_b")) - F.col("_n")  # at most BUCKETS rows
        bins = bins.withColumn("_before", before).select(*keys, F.explode("_names").alias("name"), "_n", "_before", "_from", "_to")
        found = _with(state, bins, [*keys, "name"], "left").filter(F.col("_n").isNull() | ((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))))
        state = written(
            found.select(
                *keys, "n", "max_value", F.coalesce("_from", "_low").alias("_low"), F.coalesce("_to", "_high").alias("_high"), "name",
                (F.col("rank") - F.coalesce("_before", F.lit(0))).alias("rank"),
            ),
            "ranks",
        )
    picks = [F.max(F.when(F.col("name") == name, F.col("_low"))).alias(name) for name in ranks]
    return state.groupBy(*keys).agg(F.max("n").alias("n"), *picks, F.max("max_value").alias("max_value"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at rank ceil(q * n), at least the first."""
    return _at_ranks(values, keys, value, {name: F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)) for name, q in quantiles.items()})


def lower_index_percentile(values: DataFrame, keys: list[str], value: str, quantile: float, name: str) -> DataFrame:
    """The second percentile in use: the value at zero-based index int((n - 1) * q)."""
    return _at_ranks(values, keys, value, {name: F.floor((F.col("n") - 1) * F.lit(quantile)) + 1}).select(*keys, name)


def request_summary(requests: DataFrame, key: str) -> DataFrame:
    """Requests per domain, summarised over all domains: count, median, 95th percentile, maximum."""
    per_domain = requests.groupBy(key).agg(F.count(F.lit(1)).alias("requests")).withColumn("_all", F.lit(1))
    return nearest_rank(per_domain, ["_all"], "requests", {"p50_requests": 0.50, "p95_requests": 0.95}).select(
        F.col("n").alias("domains"), "p50_requests", "p95_requests", F.col("max_value").alias("max_requests")
    )
