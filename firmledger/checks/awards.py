"""Award checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import awards as a
from ..operators import cohorts as c
from ..sources.awards import normalize_award_rows
from . import bindings as b
from .registry import check

RECENT_AWARDS_SQL = f"""matched AS (
  SELECT award.*, concat('support-award-', sha256(concat(org, '|', CAST(award_date AS VARCHAR), '|', row_sha))[1:24]) AS id
  FROM award WHERE award_date BETWEEN DATE '{b.AWARDS_AS_OF}' - 365 AND DATE '{b.AWARDS_AS_OF}'
    AND {b.org_valid_sql("org")}
    AND org IN (SELECT org FROM entity WHERE latest_submitted_accounts = '2025' AND NOT bankrupt AND NOT liquidating)
), newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY award_date DESC, id DESC) AS position FROM matched)
  WHERE position <= 5
), spans AS (
  SELECT *, concat('recipient org: ', org, '; award date: ', date_text, '; awarded amount: ', amount_text, ' NOK; support measure: ',
    measure_number, '; support type: ', measure_type, '; status: ', status) AS span,
    concat('ev-support-', sha256(concat(org, '|', id, '|{a.AWARD_SOURCE_URL}|', row_sha))[1:20]) AS evidence_id
  FROM newest
)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    return c.eligible_filers(b.entity(spark, d), "2025").select("org")


def selected_awards(spark: SparkSession, d: str) -> DataFrame:
    return a.newest_awards(normalize_award_rows(b.award_rows(spark, d)), targets(spark, d), b.AWARDS_AS_OF)


@check(
    "S4_award_rows",
    sql=b.with_ctes(
        b.AWARD_SQL,
        f"""SELECT measure_number, CASE WHEN {b.org_valid_sql("org")} THEN org ELSE '' END AS recipients,
          CAST(award_date AS VARCHAR) AS award_date, concat(whole, '.', part, '0000') AS amount, 'NOK' AS currency, status,
          measure_type, row_sha AS row_sha256 FROM award""",
    ),
)
def award_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize_award_rows(b.award_rows(spark, d))
    return rows.select(
        "measure_number",
        F.array_join("recipient_orgs", ",").alias("recipients"),
        F.col("award_date").cast("string").alias("award_date"),
        F.col("amount").cast("string").alias("amount"),
        "currency",
        "status",
        "measure_type",
        "row_sha256",
    )


@check(
    "J2_awards_of_targets",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        f"""SELECT org, measure_number FROM award WHERE {b.org_valid_sql("org")} AND org IN (SELECT org FROM entity
          WHERE latest_submitted_accounts = '2025' AND NOT bankrupt AND NOT liquidating)""",
    ),
)
def awards_of_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize_award_rows(b.award_rows(spark, d))
    return a.awards_of_targets(rows, targets(spark, d)).select("org", "measure_number")


@check(
    "W1_newest_awards",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        RECENT_AWARDS_SQL,
        "SELECT org, CAST(position AS INTEGER) AS position, id, CAST(award_date AS VARCHAR) AS award_date, span AS evidence_span FROM spans",
    ),
)
def newest_awards(spark: SparkSession, d: str) -> DataFrame:
    return selected_awards(spark, d).select(
        "org", "position", "id", F.col("award_date").cast("string").alias("award_date"), "evidence_span"
    )


@check(
    "P15_award_claims",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        RECENT_AWARDS_SQL,
        f"""SELECT org, '{a.AWARD_FIELD}' AS field, evidence_id, span AS claim_span, id AS observation_id, 1.0 AS confidence,
          CAST(award_date AS VARCHAR) AS awarded_at FROM spans""",
    ),
)
def award_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = a.award_claims(selected_awards(spark, d), b.RETRIEVED_AT)
    pointed = claims.select(
        "org", "field", F.explode("evidence_ids").alias("evidence_id"), "observation_id", "confidence",
        F.get_json_object("value", "$.awarded_at").alias("awarded_at"),
    )
    spans = evidence.select("org", F.col("id").alias("evidence_id"), "claim_span")
    return pointed.join(spans, ["org", "evidence_id"])
