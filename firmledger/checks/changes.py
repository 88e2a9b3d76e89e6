"""Change-feed and reach checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as ch
from ..operators import reach as r
from ..sources import changes as src
from . import bindings as b
from .registry import check

_PAGE_ROWS = 100


def change_events(spark: SparkSession, d: str) -> DataFrame:
    """Change rows as events with their one-element change array."""
    return b.change_rows(spark, d).select(
        "org", "event_id", "dato", "event_type", "seq", F.array(F.struct("op", "path", "value")).alias("changes")
    )


def change_targets(spark: SparkSession, d: str) -> DataFrame:
    """Companies that are not bankrupt; the feed also names others."""
    return b.entity(spark, d).filter(~F.col("bankrupt")).select("org")


def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """The events as feed pages of at most 100 events each; every seventh page announces more than it holds."""
    item = F.struct(
        F.col("org").alias("organisasjonsnummer"),
        F.col("event_id").alias("oppdateringsid"),
        F.col("dato").alias("dato"),
        F.col("event_type").alias("endringstype"),
        F.array(F.struct("op", "path", "value")).alias("endringer"),
    )
    base = b.change_rows(spark, d).filter(F.col("seq") == 0)
    page = F.floor(F.col("event_id").cast("bigint") / _PAGE_ROWS).cast("string")
    listed = base.groupBy(page.alias("page_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("event_id").cast("bigint").alias("k"), item.alias("item")))),
            lambda row: row["item"],
        ).alias("items")
    )
    announced = F.size("items") + F.when(F.pmod(F.col("page_id").cast("bigint"), F.lit(7)) == 0, 5).otherwise(0)
    body = F.to_json(
        F.struct(
            F.struct(F.col("items").alias("oppdaterteEnheter")).alias("_embedded"),
            F.struct(announced.alias("totalElements")).alias("page"),
        )
    )
    return listed.select("page_id", body.alias("payload"))


@check(
    "S6_feed_page_events",
    sql=b.with_ctes(
        b.CHANGE_SQL,
        """SELECT CAST(CAST(event_id AS BIGINT) // 100 AS VARCHAR) AS page_id, org, event_id, dato, event_type, path, op, value
          FROM change WHERE seq = 0""",
    ),
)
def feed_page_events(spark: SparkSession, d: str) -> DataFrame:
    events = src.page_events(feed_pages(spark, d))
    return events.select("page_id", "org", "event_id", "dato", "event_type", F.inline("changes")).select(
        "page_id", "org", "event_id", "dato", "event_type", "path", "op", "value"
    )


@check(
    "S6_feed_page_integrity",
    sql="""SELECT CAST(p AS VARCHAR) AS page_id, 'page is truncated' AS problem FROM (SELECT DISTINCT event_id // 100 AS p FROM events)
      WHERE p % 7 = 0""",
)
def feed_page_integrity(spark: SparkSession, d: str) -> DataFrame:
    return src.page_integrity(feed_pages(spark, d))


@check(
    "J3_unexpected_orgs",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.CHANGE_SQL,
        "SELECT org, count(*) AS events FROM change WHERE org NOT IN (SELECT org FROM entity WHERE NOT bankrupt) GROUP BY org",
    ),
)
def unexpected_orgs(spark: SparkSession, d: str) -> DataFrame:
    return ch.unexpected_orgs(change_events(spark, d), change_targets(spark, d))


NEWEST_CHANGES_SQL = f"""labelled AS (
  SELECT *, CASE path WHEN '/antallAnsatte' THEN 'registered employee count' WHEN '/naeringskode1' THEN 'registered industry'
      WHEN '/forretningsadresse/adresse' THEN 'registered business address' END AS label
  FROM change WHERE org IN (SELECT org FROM entity WHERE NOT bankrupt)
    AND dato BETWEEN '2024-01-15T00:00:00Z' AND '2024-01-26T00:00:00Z'
), deduped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org, event_id ORDER BY seq DESC) AS rn FROM labelled
    WHERE label IS NOT NULL) WHERE rn = 1
), newest AS (
  SELECT *, concat(label, CASE op WHEN 'remove' THEN ' removed' WHEN 'add' THEN concat(' added: ', value)
      ELSE concat(' updated: ', value) END) AS summary,
    sha256(concat('{{"dato":"', dato, '","endringer":[{{"op":"', op, '","path":"', path, '","value":',
      CASE WHEN value IS NULL THEN 'null' ELSE concat('"', value, '"') END, '}}],"endringstype":"', event_type,
      '","oppdateringsid":"', event_id, '","organisasjonsnummer":"', org, '"}}')) AS content_sha256
  FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY dato DESC, event_id DESC) AS position FROM deduped)
  WHERE position <= 3
)"""


def selected_changes(spark: SparkSession, d: str) -> DataFrame:
    return ch.newest_events(change_events(spark, d), change_targets(spark, d), b.EVENTS_AS_OF, lookback_days=10)


@check(
    "W2_newest_changes",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.CHANGE_SQL,
        NEWEST_CHANGES_SQL,
        "SELECT org, event_id, dato AS effective_at, CAST(position AS INTEGER) AS position, summary, content_sha256 FROM newest",
    ),
)
def newest_changes(spark: SparkSession, d: str) -> DataFrame:
    return selected_changes(spark, d).select("org", "event_id", "effective_at", "position", "summary", "content_sha256")


@check(
    "P14_change_claims",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.CHANGE_SQL,
        NEWEST_CHANGES_SQL,
        """SELECT org, concat('ev-brreg-change-', sha256(concat(org, '|brreg-change|', event_id, '|', content_sha256))[1:20]) AS evidence_id,
          summary AS claim_span, event_id AS source_row_key, summary AS value_summary FROM newest""",
    ),
)
def change_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = ch.change_claims(selected_changes(spark, d), b.RETRIEVED_AT, b.REGISTRY_URL)
    pointed = claims.select(
        "org", F.explode("evidence_ids").alias("evidence_id"), F.get_json_object("value", "$.summary").alias("value_summary")
    )
    return pointed.join(
        evidence.select("org", F.col("id").alias("evidence_id"), "claim_span", "source_row_key"), ["org", "evidence_id"]
    )


_REACH_SQL = f"""reach AS (
  SELECT e.org, count(c.org) AS events, count(c.org) > 0 AS has_history,
    count(*) FILTER (WHERE c.dato <= '{b.EVENTS_AS_OF}') AS events_last_365_days,
    count(*) FILTER (WHERE c.dato <= '{b.EVENTS_AS_OF}') AS events_last_730_days,
    max(c.dato) AS latest_update_at, max_by(c.event_type, concat(c.dato, '|', c.event_id)) AS latest_update_type
  FROM entity e LEFT JOIN change c ON e.org = c.org WHERE NOT e.bankrupt GROUP BY e.org
)"""


@check("A11_change_reach", sql=b.with_ctes(b.ENTITY_SQL, b.CHANGE_SQL, _REACH_SQL, "SELECT * FROM reach"))
def change_reach(spark: SparkSession, d: str) -> DataFrame:
    return ch.change_reach(change_events(spark, d), change_targets(spark, d), b.EVENTS_AS_OF)


@check(
    "A11_reach_summary",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.CHANGE_SQL,
        _REACH_SQL,
        """SELECT count(*) AS companies, CAST(sum(events) AS BIGINT) AS events,
          round(count(*) FILTER (WHERE has_history) / count(*), 6) AS history_reach_rate,
          round(count(*) FILTER (WHERE events_last_365_days > 0) / count(*), 6) AS recent_365_reach_rate,
          round(count(*) FILTER (WHERE events_last_730_days > 0) / count(*), 6) AS recent_730_reach_rate FROM reach""",
    ),
)
def reach_summary(spark: SparkSession, d: str) -> DataFrame:
    return ch.reach_summary(ch.change_reach(change_events(spark, d), change_targets(spark, d), b.EVENTS_AS_OF))


@check(
    "A11_top_change_paths",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.CHANGE_SQL,
        """SELECT path, count(*) AS changes FROM change WHERE org IN (SELECT org FROM entity WHERE NOT bankrupt)
          GROUP BY path ORDER BY 2 DESC, 1 LIMIT 30""",
    ),
)
def top_change_paths(spark: SparkSession, d: str) -> DataFrame:
    return ch.top_paths(ch.change_paths(change_events(spark, d), change_targets(spark, d)))


@check(
    "A10_latency_percentiles",
    sql="""SELECT event_type, count(*) AS n, CAST(quantile_disc(CAST(value AS INTEGER), 0.5) AS INTEGER) AS p50_ms,
        CAST(quantile_disc(CAST(value AS INTEGER), 0.95) AS INTEGER) AS p95_ms, CAST(max(CAST(value AS INTEGER)) AS INTEGER) AS max_ms
      FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    timed = b.table(spark, d, "events").select("event_type", F.floor("value").cast("int").alias("ms"))
    return ch.nearest_rank(timed, ["event_type"], "ms", {"p50_ms": 0.50, "p95_ms": 0.95}).withColumnRenamed("max_value", "max_ms")


@check(
    "A10_lower_index_percentile",
    sql="""SELECT event_type, list_sort(list(v))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1] AS p95_ms
      FROM (SELECT event_type, CAST(floor(value) AS INTEGER) AS v FROM events) GROUP BY event_type""",
)
def lower_index_percentile(spark: SparkSession, d: str) -> DataFrame:
    timed = b.table(spark, d, "events").select("event_type", F.floor("value").cast("int").alias("ms"))
    return ch.lower_index_percentile(timed, ["event_type"], "ms", 0.95, "p95_ms")


@check(
    "A10_requests_per_domain",
    sql="""SELECT count(*) AS domains, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50_requests,
      CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95_requests, max(n) AS max_requests
      FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)""",
)
def requests_per_domain(spark: SparkSession, d: str) -> DataFrame:
    return ch.request_summary(b.table(spark, d, "events").select("user_id"), "user_id")


def _screened_rows(spark: SparkSession, d: str) -> DataFrame:
    """Award rows with the granting authority beside the recipient; the recipient column is the only hit."""
    return b.award_rows(spark, d).withColumn("Støttegiver organisasjonsnummer", F.lit("974760673"))


@check(
    "J20_source_reach",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        f"""hits AS (SELECT org, measure_number FROM award WHERE {b.org_valid_sql("org")} AND org IN (SELECT org FROM entity WHERE NOT bankrupt))
        SELECT (SELECT count(DISTINCT measure_number) FROM hits) AS matched_rows, (SELECT count(DISTINCT org) FROM hits) AS matched_companies,
          (SELECT count(*) FROM entity WHERE NOT bankrupt) AS companies_in_cohort, (SELECT count(*) FROM award) AS rows_scanned,
          round((SELECT count(DISTINCT org) FROM hits) / (SELECT count(*) FROM entity WHERE NOT bankrupt), 6) AS company_reach""",
    ),
)
def source_reach(spark: SparkSession, d: str) -> DataFrame:
    rows, cohort = _screened_rows(spark, d), change_targets(spark, d)
    hits = r.screen_rows(rows, b.AWARD_HEADERS["measure_number"], "stotteregisteret", cohort)
    return r.screen_summary(hits, rows, cohort)


@check(
    "J20_reach_by_role",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        f"""SELECT 'recipient' AS role, count(*) AS rows FROM award WHERE {b.org_valid_sql("org")}
          AND org IN (SELECT org FROM entity WHERE NOT bankrupt)""",
    ),
)
def reach_by_role(spark: SparkSession, d: str) -> DataFrame:
    hits = r.screen_rows(
        _screened_rows(spark, d), b.AWARD_HEADERS["measure_number"], "stotteregisteret", change_targets(spark, d)
    )
    return r.role_counts(hits)


@check(
    "J21_raw_occurrences",
    sql="""WITH t AS (SELECT doc_id, concat(text, chr(10), 'Ref ', CAST(800 AS VARCHAR), '--', lpad(CAST((doc_id % 1500) // 1000 AS VARCHAR), 3, '0'),
          ' ', lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), '.') AS body, length(text) + 5 AS spot FROM documents)
      SELECT CAST(800000000 + (doc_id % 1500) // 1000 * 1000 + doc_id % 1000 AS VARCHAR) AS org, doc_id AS text_key, CAST(spot AS BIGINT) AS position,
        right(body, 13) AS written FROM t
      WHERE (doc_id % 1500) // 1000 * 1000 + doc_id % 1000 IN (SELECT c_custkey FROM customer)""",
)
def raw_occurrences(spark: SparkSession, d: str) -> DataFrame:
    # Every document names one company with odd separators at its end.
    key = F.col("doc_id")
    tail = F.concat(
        F.lit("\nRef 800--"),
        F.lpad(F.floor(F.pmod(key, F.lit(1500)) / 1000).cast("string"), 3, "0"),
        F.lit(" "),
        F.lpad(F.pmod(key, F.lit(1000)).cast("string"), 3, "0"),
        F.lit("."),
    )
    texts = b.table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text"))
    hits = r.raw_occurrences(texts, "doc_id", "text", b.entity(spark, d))
    return hits.select("org", "text_key", "position", F.right("context", F.lit(13)).alias("written"))
