"""Observation and sentiment checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OBSERVATION, conform
from ..operators import observations as o
from ..operators.claims import registry_workforce
from . import bindings as b
from . import records as rec
from .registry import check
from .stored import stored

_SIGNALS = {"view": "public_post", "click": "job_posting", "signup": "profile_handle", "purchase": "review", "error": "gossip"}


def raw_observations(spark: SparkSession, d: str) -> DataFrame:
    """One observation per event, with planted reasons for rejection."""
    e = b.table(spark, d, "events")
    key, user = F.col("event_id"), F.col("user_id")
    signal = F.lit(None).cast("string")
    for event_type, name in _SIGNALS.items():
        signal = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(signal)
    platform = F.element_at(
        F.array(*[F.lit(name) for name in ("facebook", "linkedin", "google_places", "news", "myspace")]),
        (F.pmod(key, F.lit(5)) + 1).cast("int"),
    )
    mode = (
        F.when(F.pmod(key, F.lit(11)) == 0, F.lit("jobspy_experiment"))
        .when(F.pmod(key, F.lit(3)) == 0, F.lit("official_api"))
        .otherwise(F.lit("licensed_api"))
    )
    label = F.when(
        F.col("event_type") == "purchase",
        F.element_at(
            F.array(*[F.lit(name) for name in ("positive", "neutral", "negative", "mixed")]), (F.pmod(key, F.lit(4)) + 1).cast("int")
        ),
    )
    rows = e.select(
        F.concat(F.lit("obs-"), key.cast("string")).alias("id"),
        b.org_of("user_id").alias("org"),
        platform.alias("platform"),
        signal.alias("signal_type"),
        F.concat(F.lit("https://www.site"), F.pmod(key, F.lit(7)).cast("string"), F.lit(".example/"), F.pmod(key, F.lit(100)).cast("string")).alias(
            "source_url"
        ),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"),
        F.when(F.pmod(key, F.lit(13)) != 0, F.sha2("props", 256)).alias("content_sha256"),
        (F.pmod(key, F.lit(17)) != 0).alias("exact_entity"),
        F.array(F.create_map(F.lit("type"), F.lit("event"))).alias("identity_proof"),
        mode.alias("acquisition_mode"),
        F.when(F.pmod(user, F.lit(9)) == 0, F.lit("review_required")).otherwise(F.lit("approved")).alias("rights_status"),
        F.lit("customer_review").alias("source_class"),
        F.when(F.pmod(key, F.lit(19)) != 0, F.col("props")).alias("evidence_span"),
        F.create_map(F.lit("likes"), F.get_json_object("props", "$.k"), F.lit("shares"), F.lit("1")).alias("metrics"),
        label.alias("sentiment_label"),
        F.lit("stars_v1").alias("sentiment_model_version"),
        F.when(F.pmod(key, F.lit(2)) == 0, F.concat(F.lit("r"), F.pmod(key, F.lit(50)).cast("string"))).alias("reviewer_id"),
    )
    return conform(rows, OBSERVATION)


def observations(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "observations", lambda: o.validated(raw_observations(spark, d)))


OBS_SQL = """obs AS (
  SELECT event_id AS k, user_id AS u, event_type, ts, concat('obs-', event_id) AS id, CAST(800000000 + user_id AS VARCHAR) AS org,
    ['facebook', 'linkedin', 'google_places', 'news', 'myspace'][event_id % 5 + 1] AS platform,
    CASE event_type WHEN 'view' THEN 'public_post' WHEN 'click' THEN 'job_posting' WHEN 'signup' THEN 'profile_handle'
      WHEN 'purchase' THEN 'review' ELSE 'gossip' END AS signal_type,
    concat('https://www.site', event_id % 7, '.example/', event_id % 100) AS source_url,
    CASE WHEN event_type = 'purchase' THEN ['positive', 'neutral', 'negative', 'mixed'][event_id % 4 + 1] END AS label,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS likes,
    list_filter([
      CASE WHEN event_id % 5 = 4 THEN 'unknown_platform' END,
      CASE WHEN event_type = 'error' THEN 'unknown_signal' END,
      CASE WHEN event_id % 13 = 0 THEN 'no_full_hash' END,
      CASE WHEN event_id % 17 = 0 THEN 'entity_not_exact' END,
      CASE WHEN event_id % 11 = 0 THEN 'mode_not_publishable' END,
      CASE WHEN user_id % 9 = 0 THEN 'rights_not_approved' END,
      CASE WHEN event_id % 19 = 0 AND event_type IN ('purchase', 'view') THEN 'no_span' END], lambda r: r IS NOT NULL) AS reasons
  FROM events
), ok AS (SELECT * FROM obs WHERE len(reasons) = 0)"""


@check("F3_observation_reasons", sql=b.with_ctes(OBS_SQL, "SELECT id, array_to_string(reasons, '; ') AS reasons FROM obs"))
def observation_reasons(spark: SparkSession, d: str) -> DataFrame:
    return o.validated(raw_observations(spark, d)).select("id", F.array_join("reasons", "; ").alias("reasons"))


@check("F3_rejections", sql=b.with_ctes(OBS_SQL, "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM obs) GROUP BY reason"))
def rejections(spark: SparkSession, d: str) -> DataFrame:
    return o.rejections(observations(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A1_footprints",
    sql=b.with_ctes(
        OBS_SQL,
        f"""f AS (
          SELECT org, count(*) FILTER (WHERE len(reasons) = 0) AS accepted_observations, count(*) FILTER (WHERE len(reasons) > 0) AS rejected_observations,
            count(*) FILTER (WHERE len(reasons) = 0 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-25' - INTERVAL 10 DAY AND TIMESTAMP '2024-01-25') AS fresh_observations,
            count(*) FILTER (WHERE len(reasons) = 0 AND signal_type = 'review') AS review_signal_count,
            count(DISTINCT CASE WHEN len(reasons) = 0 AND signal_type = 'job_posting' THEN source_url END) AS active_job_count,
            count(DISTINCT CASE WHEN len(reasons) = 0 AND signal_type = 'public_post' THEN source_url END) AS public_item_count,
            CAST(coalesce(sum(likes + 1) FILTER (WHERE len(reasons) = 0 AND signal_type = 'public_post'), 0) AS BIGINT) AS public_engagement,
            count(*) FILTER (WHERE len(reasons) = 0 AND label IS NOT NULL) AS sentiment_items,
            count(DISTINCT CASE WHEN len(reasons) = 0 AND label IS NOT NULL THEN k % 7 END) AS sentiment_sources,
            count(DISTINCT CASE WHEN len(reasons) = 0 AND label IS NOT NULL AND k % 2 = 0 THEN k % 50 END) AS sentiment_reviewers,
            avg(CASE label WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.0 WHEN 'negative' THEN -1.0 END) FILTER (WHERE len(reasons) = 0) AS mean
          FROM obs GROUP BY org)
        SELECT * EXCLUDE (mean), CASE WHEN accepted_observations > 0 THEN 'available' ELSE 'not_available' END AS status,
          CASE WHEN sentiment_items >= 10 AND (sentiment_sources >= 2 OR sentiment_reviewers >= 10) THEN 'available' ELSE 'abstain' END AS sentiment_status,
          CASE WHEN sentiment_items >= 10 AND (sentiment_sources >= 2 OR sentiment_reviewers >= 10) THEN round_even(50 + 50 * mean, 1) END AS sentiment_score
        FROM f""",
    ),
)
def footprints(spark: SparkSession, d: str) -> DataFrame:
    return o.footprints(observations(spark, d), b.EVENTS_AS_OF, freshness_days=10)


@check(
    "A1_platform_counts",
    sql=b.with_ctes(OBS_SQL, "SELECT org, platform, count(*) AS observations FROM ok GROUP BY 1, 2"),
)
def platform_counts(spark: SparkSession, d: str) -> DataFrame:
    return o.platform_counts(observations(spark, d))


@check(
    "U6_union_by_id",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        OBS_SQL,
        f"""SELECT CASE WHEN k % 4 = 0 THEN 'later' ELSE 'first' END AS family, count(*) AS n FROM obs GROUP BY 1
          UNION ALL SELECT 'workforce', count(*) FROM entity WHERE {rec.LIVE_OK_SQL} AND employees IS NOT NULL""",
    ),
)
def union_by_id(spark: SparkSession, d: str) -> DataFrame:
    first = raw_observations(spark, d).withColumn("strategy", F.lit("first"))
    number = F.substring("id", 5, 20).cast("bigint")
    later = first.filter(F.pmod(number, F.lit(4)) == 0).withColumn("strategy", F.lit("later"))
    workforce = registry_workforce(rec.modules(spark, d, "registry_live")).withColumn("strategy", F.lit("workforce"))
    rows = o.union_by_id([first, later, workforce])
    return rows.groupBy(F.col("strategy").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def _sentiment_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as sentiment items: the label by length, the source class by source, some faults planted."""
    key = F.col("doc_id")
    return b.table(spark, d, "documents").select(
        key.alias("id"),
        b.org_of(F.pmod(key, F.lit(60))).alias("org"),
        F.when(F.col("n_chars") % 4 == 0, F.lit("neutral"))
        .when(F.col("n_chars") % 4 == 1, F.lit("negative"))
        .when(F.col("n_chars") % 4 == 2, F.lit("positive"))
        .otherwise(F.lit("mixed"))
        .alias("label"),
        "source",
        F.col("source").alias("source_id"),
        F.lit("https://news.example/").alias("source_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.col("text"),
        F.col("text").alias("evidence_span"),
        F.sha2("text", 256).alias("content_sha256"),
        (F.pmod(key, F.lit(7)) != 0).alias("exact_entity"),
        F.when(F.col("source").isin("src1", "src2", "src3", "src4", "src5"), F.lit("public_news"))
        .when(F.col("source") == "src6", F.lit("licensed_news"))
        .otherwise(F.lit("blog"))
        .alias("source_class"),
    )


_ITEM_SQL = """items AS (
  SELECT doc_id AS id, CAST(800000000 + doc_id % 60 AS VARCHAR) AS org, source,
    CASE n_chars % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'negative' WHEN 2 THEN 'positive' ELSE 'mixed' END AS label,
    doc_id % 7 <> 0 AS exact, source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') AS independent
  FROM documents
)"""


@check(
    "F4_sentiment_eligibility",
    sql=b.with_ctes(
        _ITEM_SQL,
        """SELECT id, concat_ws('; ', CASE WHEN NOT exact THEN 'exact company identity is not verified' END,
          CASE WHEN NOT independent THEN 'source is not an allowed independent class' END) AS reasons FROM items""",
    ),
)
def sentiment_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return _sentiment_items(spark, d).select("id", F.array_join(o.sentiment_reasons(F.col("text")), "; ").alias("reasons"))


@check(
    "A2_company_sentiment",
    sql=b.with_ctes(
        _ITEM_SQL,
        """c AS (SELECT org, count(*) FILTER (WHERE exact AND independent) AS accepted_items,
            count(*) FILTER (WHERE NOT (exact AND independent)) AS rejected_items,
            count(DISTINCT source) FILTER (WHERE exact AND independent) AS independent_sources,
            count(DISTINCT label) FILTER (WHERE exact AND independent AND label <> 'neutral') AS kinds,
            max(label) FILTER (WHERE exact AND independent AND label <> 'neutral') AS only_label FROM items GROUP BY org)
        SELECT org, CASE WHEN independent_sources >= 2 THEN 'available' ELSE 'abstain' END AS status,
          CASE WHEN independent_sources >= 2 THEN CASE WHEN kinds = 0 THEN 'neutral' WHEN kinds = 1 THEN only_label ELSE 'mixed' END END AS label,
          accepted_items, rejected_items, independent_sources FROM c""",
    ),
)
def company_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return o.company_sentiment(_sentiment_items(spark, d))


def _gold(spark: SparkSession, d: str) -> DataFrame:
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("positive"))
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit("neutral"))
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("negative"))
        .otherwise(F.lit("mixed"))
    )
    return b.table(spark, d, "labels").select(F.col("doc_id").alias("id"), label.alias("label"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Only every document outside multiples of nine has a prediction."""
    return _sentiment_items(spark, d).filter(F.pmod("id", F.lit(9)) != 0)


_GOLD_SQL = """gold AS (
  SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN quality = 0 AND toxic = 0 THEN 'neutral'
    WHEN quality = 0 THEN 'negative' ELSE 'mixed' END AS actual FROM labels
), pairs AS (SELECT gold.id, actual, label AS predicted, exact, independent FROM gold LEFT JOIN items ON gold.id = items.id AND items.id % 9 <> 0
), per_label AS (
  SELECT l AS label, count(*) FILTER (WHERE actual = l AND predicted = l) AS tp,
    count(*) FILTER (WHERE actual <> l AND predicted = l) AS fp,
    count(*) FILTER (WHERE actual = l AND predicted IS DISTINCT FROM l) AS fn
  FROM pairs, (VALUES ('positive'), ('neutral'), ('negative'), ('mixed')) t(l) GROUP BY l
), rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM per_label
)"""


@check(
    "A3_per_label_quality",
    sql=b.with_ctes(
        _ITEM_SQL,
        _GOLD_SQL,
        """SELECT label, tp, fp, fn, tp + fn AS support, round(p, 9) AS "precision", round(r, 9) AS recall,
          round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM rated""",
    ),
)
def per_label_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = o.confusion(_gold(spark, d), _predictions(spark, d))
    rates = [F.round(name, 9).alias(name) for name in ("precision", "recall", "f1")]
    return rows.select("label", "tp", "fp", "fn", "support", *rates)


@check(
    "A3_classifier_gate",
    sql=b.with_ctes(
        _ITEM_SQL,
        _GOLD_SQL,
        """SELECT count(*) AS gold_items, count(predicted) AS published_predictions,
          round(count(*) FILTER (WHERE actual = predicted) / count(*), 9) AS accuracy,
          (SELECT round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) FROM rated WHERE tp + fn > 0) AS macro_f1,
          count(*) FILTER (WHERE predicted IS NOT NULL AND NOT exact) AS wrong_entity_predictions,
          round(count(predicted) / count(*), 9) AS coverage,
          round(count(*) FILTER (WHERE exact AND independent) / count(predicted), 9) AS evidence_support_rate, false AS qualification_passed
        FROM pairs""",
    ),
)
def classifier_gate(spark: SparkSession, d: str) -> DataFrame:
    row = o.evaluate_sentiment(_gold(spark, d), _predictions(spark, d))
    rates = [F.round(name, 9).alias(name) for name in ("accuracy", "macro_f1", "coverage", "evidence_support_rate")]
    return row.select("gold_items", "published_predictions", *rates, "wrong_entity_predictions", "qualification_passed")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return b.entity(spark, d).filter(F.col("website").isNotNull() & (F.pmod(rec.key(), F.lit(2)) == 0)).select("org")


_SCORE_SQL = """s AS (
  SELECT org, u, count(*) FILTER (WHERE good) AS accepted_observations,
    count(*) FILTER (WHERE trial) AS experimental_observations,
    count(DISTINCT platform) FILTER (WHERE good AND signal_type = 'profile_handle') AS handles,
    count(DISTINCT platform) FILTER (WHERE (good OR trial) AND signal_type = 'profile_handle') AS handles_x,
    bool_or(good AND signal_type = 'review') AS reviews, bool_or((good OR trial) AND signal_type = 'review') AS reviews_x,
    bool_or(good AND signal_type = 'job_posting') AS jobs, bool_or((good OR trial) AND signal_type = 'job_posting') AS jobs_x,
    bool_or(good AND signal_type = 'public_post') AS buzz, bool_or((good OR trial) AND signal_type = 'public_post') AS buzz_x,
    count(*) FILTER (WHERE good AND label IS NOT NULL) >= 10 AND (count(DISTINCT k % 7) FILTER (WHERE good AND label IS NOT NULL) >= 2
      OR count(DISTINCT k % 50) FILTER (WHERE good AND label IS NOT NULL AND k % 2 = 0) >= 10) AS sentiment,
    count(*) FILTER (WHERE trial AND label IS NOT NULL) >= 10 AND (count(DISTINCT k % 7) FILTER (WHERE trial AND label IS NOT NULL) >= 2
      OR count(DISTINCT k % 50) FILTER (WHERE trial AND label IS NOT NULL AND k % 2 = 0) >= 10) AS sentiment_x
  FROM (SELECT *, len(reasons) = 0 AS good, k % 11 = 0 AND k % 13 <> 0 AND k % 17 <> 0 AS trial FROM obs) GROUP BY org, u
)"""


@check(
    "A4_development_scores",
    sql=b.with_ctes(
        OBS_SQL,
        _SCORE_SQL,
        """SELECT org, accepted_observations, experimental_observations,
          CASE WHEN u % 6 = 0 AND accepted_observations > 0 THEN 20 ELSE 0 END + least(15, handles * 5) + CASE WHEN reviews THEN 10 ELSE 0 END
            + CASE WHEN jobs THEN 10 ELSE 0 END + CASE WHEN buzz THEN 10 ELSE 0 END + CASE WHEN sentiment THEN 15 ELSE 0 END
            + CASE WHEN accepted_observations > 0 THEN 5.0 ELSE 0 END AS score,
          CASE WHEN u % 6 = 0 AND accepted_observations + experimental_observations > 0 THEN 20 ELSE 0 END + least(15, handles_x * 5) + CASE WHEN reviews_x THEN 10 ELSE 0 END
            + CASE WHEN jobs_x THEN 10 ELSE 0 END + CASE WHEN buzz_x THEN 10 ELSE 0 END + CASE WHEN sentiment OR sentiment_x THEN 15 ELSE 0 END
            + CASE WHEN accepted_observations > 0 THEN 5.0 ELSE 0 END AS experimental_potential_score FROM s""",
    ),
)
def development_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = o.development_scores(observations(spark, d), _sites(spark, d))
    return rows.select("org", "accepted_observations", "experimental_observations", "score", "experimental_potential_score")


@check(
    "A5_strategy_statistics",
    sql=f"""WITH listed AS (SELECT unnest({list(o.STRATEGIES)}) AS strategy, unnest(range({len(o.STRATEGIES)})) AS i),
      runs AS (SELECT {list(o.STRATEGIES)}[event_id % 12 + 1] AS strategy, CAST(floor(value) AS BIGINT) - 20 AS gain FROM events),
      g AS (SELECT listed.strategy, i, count(gain) AS n, count(*) FILTER (WHERE gain > 0) AS good, coalesce(avg(gain), 0) AS mean
        FROM listed LEFT JOIN runs ON listed.strategy = runs.strategy GROUP BY 1, 2)
      SELECT strategy, n AS prior_runs, good AS prior_successes, round_even(mean, 3) AS prior_mean_learning_gain,
        CAST(row_number() OVER (ORDER BY mean + 0.35 * sqrt(ln((SELECT count(*) FROM events) + 1) / (n + 1)) DESC, i) AS INTEGER) AS rank FROM g""",
)
def strategy_statistics(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(name) for name in o.STRATEGIES])
    runs = b.table(spark, d, "events").select(
        F.element_at(names, (F.pmod("event_id", F.lit(12)) + 1).cast("int")).alias("strategy"),
        (F.floor("value") - 20).cast("double").alias("gain"),
    )
    return o.strategy_statistics(runs)


@check(
    "A7_footprint_coverage",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        OBS_SQL,
        """c AS (SELECT org, count(DISTINCT platform) AS p, bool_or(signal_type = 'job_posting') AS j, bool_or(signal_type = 'review') AS r,
            bool_or(signal_type = 'public_post') AS m, bool_or(label IS NOT NULL) AS s FROM ok GROUP BY org)
        SELECT round(count(*) FILTER (WHERE p >= 1) / count(*), 9) AS any_external, round(count(*) FILTER (WHERE p >= 2) / count(*), 9) AS two_platforms,
          round(count(*) FILTER (WHERE j) / count(*), 9) AS workforce_jobs, round(count(*) FILTER (WHERE r) / count(*), 9) AS ratings_reviews,
          round(count(*) FILTER (WHERE m) / count(*), 9) AS buzz_engagement, round(count(*) FILTER (WHERE s) / count(*), 9) AS sentiment
        FROM entity LEFT JOIN c ON entity.org = c.org""",
    ),
)
def footprint_coverage(spark: SparkSession, d: str) -> DataFrame:
    row = o.footprint_coverage(b.entity(spark, d), observations(spark, d))
    return row.select(*[F.round(name, 9).alias(name) for name in row.columns])


@check(
    "A7_footprint_precision",
    sql=b.with_ctes(
        OBS_SQL,
        """a AS (SELECT *, k % 50 <> 1 AS right_entity, k % 70 <> 1 AS right_metric, k % 3 = 0 AS right_label FROM obs WHERE k % 2 = 1),
        c AS (SELECT count(*) AS audited_observations, count(*) FILTER (WHERE len(reasons) = 0) AS published_audited,
            count(*) FILTER (WHERE len(reasons) = 0 AND NOT right_entity) AS wrong_entity_publications,
            count(*) FILTER (WHERE len(reasons) = 0 AND NOT right_metric) AS wrong_metric_publications,
            count(*) FILTER (WHERE len(reasons) = 0 AND label IS NOT NULL) AS sentiment_audited,
            count(*) FILTER (WHERE len(reasons) = 0 AND label IS NOT NULL AND right_label) AS s FROM a)
        SELECT c.* EXCLUDE (s), true AS audit_size_gate, round((published_audited - wrong_entity_publications) / published_audited, 9) AS entity_precision,
          round((published_audited - wrong_metric_publications) / published_audited, 9) AS metric_precision,
          round(s / sentiment_audited, 9) AS sentiment_accuracy, false AS qualification_passed FROM c""",
    ),
)
def footprint_precision(spark: SparkSession, d: str) -> DataFrame:
    key = F.substring("id", 5, 20).cast("bigint")
    labels = raw_observations(spark, d).filter(F.pmod(key, F.lit(2)) == 1).select(
        "id",
        (F.pmod(key, F.lit(50)) != 1).alias("exact_entity"),
        (F.pmod(key, F.lit(70)) != 1).alias("metric_correct"),
        (F.pmod(key, F.lit(3)) == 0).alias("sentiment_correct"),
    )
    row = o.footprint_precision(observations(spark, d), labels)
    rates = ("entity_precision", "metric_precision", "sentiment_accuracy")
    return row.select(*[F.round(name, 9).alias(name) if name in rates else F.col(name) for name in row.columns])


@check(
    "A14_observation_audit",
    sql=b.with_ctes(
        OBS_SQL,
        """SELECT error, count(*) AS n FROM (SELECT unnest(reasons) AS error FROM obs
          UNION ALL SELECT 'external observation organisation number mismatch' FROM obs WHERE u % 10 = 3) GROUP BY error""",
    ),
)
def observation_audit(spark: SparkSession, d: str) -> DataFrame:
    filed = observations(spark, d).withColumn(
        "filed_under", F.when(F.endswith("org", F.lit("3")), F.lit("800000000")).otherwise(F.col("org"))
    )
    return o.observation_audit(filed, "filed_under").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A14_signal_companies",
    sql=b.with_ctes(
        OBS_SQL, "SELECT signal_type, platform, count(DISTINCT org) AS companies, count(*) AS observations FROM obs GROUP BY 1, 2"
    ),
)
def signal_companies(spark: SparkSession, d: str) -> DataFrame:
    return o.signal_companies(observations(spark, d))


@check(
    "F13_connector_tasks",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """t AS (
          SELECT org, name, municipality, connector, purpose, CAST(NULL AS VARCHAR) AS candidate_url FROM entity,
            (VALUES ('google_places_api', 'resolve_places_and_public_rating'), ('licensed_news_search', 'discover_independent_mentions'),
              ('jobs_provider', 'discover_active_jobs')) v(connector, purpose)
          UNION ALL SELECT org, name, municipality, 'facebook_connector', 'refresh_verified_profile_metrics', concat('https://facebook.com/kunde', k)
            FROM entity WHERE k % 18 = 0
          UNION ALL SELECT org, name, municipality, 'permitted_search_api', 'discover_social_handles', NULL FROM entity WHERE k % 18 <> 0)
        SELECT org, connector, purpose, candidate_url, sha256(concat('{"candidate_url":', CASE WHEN candidate_url IS NULL THEN 'null' ELSE concat('"', candidate_url, '"') END,
          ',"company_name":"', name, '","connector":"', connector, '","municipality":"', municipality, '","organisation_number":"', org,
          '","purpose":"', purpose, '"}'))[1:24] AS task_id FROM t""",
    ),
)
def connector_tasks(spark: SparkSession, d: str) -> DataFrame:
    site = rec.modules(spark, d, "website")
    links = site.select(
        "org",
        F.explode(F.from_json(F.get_json_object("value", "$.social_links"), "array<struct<platform:string,url:string>>")).alias("l"),
    ).select("org", "l.*")
    return o.connector_tasks(b.entity(spark, d), links).select("org", "connector", "purpose", "candidate_url", "task_id")


@check(
    "F13_search_queries",
    sql=b.with_ctes(b.ENTITY_SQL, """SELECT org, concat('"', name, '" ', org, ' ', municipality) AS query FROM entity"""),
)
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return o.search_queries(b.entity(spark, d))
