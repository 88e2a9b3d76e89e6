"""Audit and delta checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CLAIM, conform
from ..operators import audits as a
from ..operators import discovery
from ..operators import observations as obs
from ..operators import provenance as prov
from ..operators import refresh as rf
from ..operators.awards import AWARD_FIELD
from ..operators.claims import narrative_claims, replace_managed, owns_narrative_claim
from ..operators.reports import annual_description_claims, description_observations
from . import bindings as b
from . import records as rec
from .awards import RECENT_AWARDS_SQL
from .claims import all_claim_rows, all_claims, base, evidence_rows
from .observations import observations
from .registry import check
from .reports import DESCRIPTION, reports

_BASE = (b.ENTITY_SQL, b.ACCOUNTS_SQL)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return obs.development_scores(observations(spark, d), b.entity(spark, d).filter(F.lit(False)))


def _complete(spark: SparkSession, d: str) -> DataFrame:
    return a.completeness(b.entity(spark, d), rec.modules(spark, d), _scores(spark, d))


_FOUNDATION = f"""CASE WHEN {rec.LIVE_OK_SQL} THEN 5 ELSE 0 END + CASE WHEN org IN (SELECT org FROM accounts) THEN 10 ELSE 0 END + 10
  + CASE WHEN website IS NOT NULL THEN 5.0 ELSE 0 END"""


@check("A6_foundation_scores", sql=b.with_ctes(*_BASE, f"SELECT org, {_FOUNDATION} AS foundation_score FROM entity"))
def foundation_scores(spark: SparkSession, d: str) -> DataFrame:
    return _complete(spark, d).select("org", "foundation_score")


@check(
    "A6_completeness_summary",
    sql=b.with_ctes(
        *_BASE,
        f"""f AS (SELECT legal_form, {_FOUNDATION} AS s, {rec.LIVE_OK_SQL} AS live FROM entity)
        SELECT legal_form, count(*) AS companies, round_even(avg(s), 3) AS foundation_mean, round_even(avg(live::INT), 4) AS coverage_foundation_official_identity
        FROM f GROUP BY legal_form""",
    ),
)
def completeness_summary(spark: SparkSession, d: str) -> DataFrame:
    scored = _complete(spark, d).join(b.entity(spark, d).select("org", "legal_form"), "org")
    return a.completeness_summary(scored, "legal_form").select(
        "legal_form", "companies", "foundation_mean", "coverage_foundation_official_identity"
    )


@check(
    "A6_distribution_total",
    sql="SELECT count(*) AS companies FROM customer",
)
def distribution_total(spark: SparkSession, d: str) -> DataFrame:
    return a.completeness_distribution(_complete(spark, d)).agg(F.sum("companies").alias("companies"))


@check(
    "A18_foundation_ratios",
    sql=b.with_ctes(
        *_BASE,
        f"""SELECT round(avg(({rec.LIVE_OK_SQL})::INT), 9) AS official_identity, round(avg((org IN (SELECT org FROM accounts))::INT), 9) AS annual_accounts,
          1.0 AS roles_and_locations, round(avg((website IS NOT NULL)::INT), 9) AS website_terminal_state FROM entity""",
    ),
)
def foundation_ratios(spark: SparkSession, d: str) -> DataFrame:
    row = a.foundation_ratios(b.entity(spark, d), rec.module_states(spark, d, *rec.MODULES))
    return row.select(*[F.round(name, 9).alias(name) for name in row.columns])


@check(
    "A8_field_coverage",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        RECENT_AWARDS_SQL,
        """n AS (SELECT count(*) AS t FROM entity), c AS (
          SELECT 'official_website' AS field, count(*) AS n FROM entity WHERE website IS NOT NULL AND k % 2 = 0
          UNION ALL SELECT 'social_links', count(*) FROM entity WHERE k % 18 = 0
          UNION ALL SELECT 'official.support_award', count(DISTINCT org) FROM newest
          UNION ALL SELECT unnest(['external.profile_handle', 'external.contact_email', 'external.careers_page', 'external.job_posting',
            'external.company_update', 'external.workforce_snapshot']), 0)
        SELECT field, n AS companies, t AS total_companies, round_even(100.0 * n / t, 1) AS company_coverage_pct FROM c, n""",
    ),
)
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    claims = all_claim_rows(spark, d)
    return a.field_coverage(b.entity(spark, d), claims)


def _surface_sites(spark: SparkSession, d: str) -> DataFrame:
    site = b.entity(spark, d).filter(F.col("website").isNotNull() & (F.pmod(rec.key(), F.lit(2)) == 0))
    return site.select(
        "org", (F.pmod(rec.key(), F.lit(4)) == 0).alias("careers_links"), F.lit(False).alias("news_detail_links"),
        F.lit(False).alias("active_hiring"), F.lit(False).alias("job_listing_candidates"),
    )


@check(
    "A8_site_yield",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """s AS (SELECT count(*) AS verified_sites, count(*) FILTER (WHERE k % 4 = 0) AS c FROM entity WHERE website IS NOT NULL AND k % 2 = 0)
        SELECT verified_sites, 'careers_links' AS metric, c AS companies, round_even(100.0 * c / verified_sites, 1) AS conditional_yield_pct, 'measured_surface_available' AS decision FROM s
        UNION ALL SELECT verified_sites, m, 0, 0.0, x FROM s, (VALUES ('profile_handle', 'extractor_or_source_gap'), ('contact_email', 'extractor_or_source_gap'),
          ('news_detail_links', 'no_surface_in_verified_site_sample'), ('active_hiring', 'measured_surface_available'), ('job_listing_candidates', 'measured_surface_available')) v(m, x)""",
    ),
)
def site_yield(spark: SparkSession, d: str) -> DataFrame:
    claims = all_claim_rows(spark, d)
    return a.site_yield(b.entity(spark, d), claims, _surface_sites(spark, d))


def _visibility(spark: SparkSession, d: str) -> DataFrame:
    return a.marked_visibility(all_claim_rows(spark, d), evidence_rows(spark, d, a.with_marks))


@check(
    "A9_evidence_visibility",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT 'legal_name' AS field, count(*) AS available_claims, count(*) AS core_evidence_complete, count(*) AS reopenable_source,
            0 AS identity_sensitive_claims, 0 AS identity_proof_visible FROM entity
          UNION ALL SELECT 'official_website', count(*), count(*), count(*), count(*), 0 FROM entity WHERE website IS NOT NULL AND k % 2 = 0""",
    ),
)
def evidence_visibility(spark: SparkSession, d: str) -> DataFrame:
    rows = a.visibility_by_field(_visibility(spark, d))
    return rows.filter(F.col("field").isin("legal_name", "official_website")).select(
        "field", "available_claims", "core_evidence_complete", "reopenable_source", "identity_sensitive_claims", "identity_proof_visible"
    )


@check(
    "A9_visibility_issues",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT missing, count(*) AS n FROM entity, (VALUES ('identity_proof'), ('extraction_method')) m(missing)
          WHERE website IS NOT NULL AND k % 2 = 0 GROUP BY missing""",
    ),
)
def visibility_issues(spark: SparkSession, d: str) -> DataFrame:
    issues = a.visibility_issues(_visibility(spark, d))
    return issues.filter(F.col("field") == "official_website").groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@check(
    "J17_visible_provenance",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE WHEN k % 4 = 0 THEN 'gate' END AS identity_proof, CASE WHEN k % 4 = 0 THEN 'method_v1' END AS extraction_method
          FROM entity WHERE website IS NOT NULL AND k % 2 = 0""",
    ),
)
def visible_provenance(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = all_claims(spark, d)
    # Only every second verified site was retained with the hash that the evidence cites.
    retained = rec.modules(spark, d, "website").select(
        "org", F.col("source_url").alias("final_url"),
        F.when(F.pmod(rec.key(), F.lit(4)) == 0, F.col("content_sha256")).otherwise(F.lit("other")).alias("content_sha256"),
        F.lit("gate").alias("identity_proof"), F.lit("method_v1").alias("method"),
    )
    none = observations(spark, d).filter(F.lit(False))
    filled = prov.visible_provenance(claims, evidence, none, retained)
    ids = claims.filter((F.col("field") == "official_website") & (F.col("availability") == "available")).select(
        "org", F.explode("evidence_ids").alias("id")
    )
    return filled.join(ids, ["org", "id"], "left_semi").select("org", "identity_proof", "extraction_method")


@check(
    "J18_award_provenance",
    sql=b.with_ctes(b.ENTITY_SQL, b.AWARD_SQL, RECENT_AWARDS_SQL, "SELECT count(*) AS award_rows, count(*) AS with_method FROM newest"),
)
def award_provenance(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = all_claim_rows(spark, d), evidence_rows(spark, d)
    bare = evidence.withColumn("extraction_method", F.lit(None).cast("string"))
    filled = prov.award_provenance(claims, bare).filter(F.startswith("id", F.lit("ev-support-")))
    return filled.agg(F.count(F.lit(1)).alias("award_rows"), F.count("extraction_method").alias("with_method"))


def _old_claims(spark: SparkSession, d: str) -> DataFrame:
    """The earlier run: no awards, and one company in ten without its website claim."""
    claims = all_claim_rows(spark, d)
    gone = (F.col("field") == AWARD_FIELD) | ((F.col("field") == "legal_form") & (F.pmod(rec.key(), F.lit(10)) == 0))
    extra = claims.filter((F.col("field") == "municipality") & (F.pmod(rec.key(), F.lit(7)) == 0))
    return claims.filter(~gone).unionByName(extra)


@check(
    "U1_membership_difference",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, CASE WHEN c_custkey % 6 = 0 THEN 'current_only' ELSE 'previous_only' END AS side FROM customer
      WHERE (c_custkey % 6 = 0) <> (c_custkey % 4 = 0)""",
)
def membership_difference(spark: SparkSession, d: str) -> DataFrame:
    entities = b.entity(spark, d)
    old, new = entities.filter(F.pmod(rec.key(), F.lit(4)) == 0), entities.filter(F.pmod(rec.key(), F.lit(6)) == 0)
    return rf.membership_difference(old, new)


@check(
    "U2_claim_delta",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.AWARD_SQL,
        RECENT_AWARDS_SQL,
        """SELECT 'added' AS change, 'official.support_award' AS field, count(*) AS claims FROM newest
          UNION ALL SELECT 'added', 'legal_form', count(*) FROM entity WHERE k % 10 = 0
          UNION ALL SELECT 'removed', 'municipality', count(*) FROM entity WHERE k % 7 = 0""",
    ),
)
def claim_delta(spark: SparkSession, d: str) -> DataFrame:
    claims = all_claim_rows(spark, d)
    return a.claim_delta_by_field(a.claim_delta(_old_claims(spark, d), claims))


@check(
    "U3_coverage_delta",
    sql=b.with_ctes(
        b.ENTITY_SQL, b.AWARD_SQL, RECENT_AWARDS_SQL, "SELECT DISTINCT 'official.support_award' AS field, org, 'gained' AS change FROM newest"
    ),
)
def coverage_delta(spark: SparkSession, d: str) -> DataFrame:
    claims = all_claim_rows(spark, d)
    return a.coverage_delta(_old_claims(spark, d), claims)


@check(
    "U4_forbidden_publications",
    sql=b.with_ctes(b.ENTITY_SQL, "SELECT org, 'legal_name' AS field, lower(label) AS needle FROM entity WHERE k % 5 = 0"),
)
def forbidden_publications(spark: SparkSession, d: str) -> DataFrame:
    claims = all_claim_rows(spark, d)
    needles = b.entity(spark, d).filter(F.pmod(rec.key(), F.lit(5)) == 0).select("org", F.upper("industry_label").alias("needle"))
    return a.forbidden_publications(claims.filter(F.col("field") == "legal_name"), needles)


@check(
    "A15_narrative_gain",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT 'company_description' AS field, count(*) FILTER (WHERE k % 12 = 0) AS "before", count(*) AS "after", count(*) FILTER (WHERE k % 12 <> 0) AS net_new, 0 AS lost
          FROM entity WHERE k % 12 = 0 OR ({rec.LIVE_OK_SQL} AND k % 2 = 0)""",
    ),
)
def narrative_gain(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = base(spark, d)
    pair = narrative_claims(claims, rec.modules(spark, d, "registry_live"))
    after, _ = replace_managed(claims, evidence, owns_narrative_claim(), *pair)
    return a.projection_gain(claims, after, "company_description")


@check("A15_narrative_idempotence", sql="SELECT 0 AS only_left, 0 AS only_right")
def narrative_idempotence(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = base(spark, d)
    modules = rec.modules(spark, d, "registry_live")
    once, held = replace_managed(claims, evidence, owns_narrative_claim(), *narrative_claims(claims, modules))
    twice, _ = replace_managed(once, held, owns_narrative_claim(), *narrative_claims(once, modules))
    row = a.table_difference(once, twice)
    return row.select(F.col("only_left").cast("int").alias("only_left"), F.col("only_right").cast("int").alias("only_right"))


@check(
    "A16_description_audit",
    sql=f"""WITH o AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 13 <> 0 AND doc_id IN (SELECT c_custkey FROM customer))
      SELECT 'observations' AS metric, count(*) AS n FROM o UNION ALL SELECT 'companies_with_duplicates', 0 UNION ALL SELECT 'claims_without_observation', 0
      UNION ALL SELECT 'suppressed_observations', count(*) FROM o WHERE doc_id % 4 = 0 UNION ALL SELECT 'reports_shared_by_companies', 0 -- {len(DESCRIPTION)}""",
)
def description_audit(spark: SparkSession, d: str) -> DataFrame:
    texts = reports(spark, d)
    found = description_observations(texts, b.entity(spark, d))
    held = texts.filter(F.pmod("doc_id", F.lit(4)) == 0).select("org", F.lit("company_description").alias("field"), F.lit("available").alias("availability"))
    claims, _ = annual_description_claims(conform(held, CLAIM), obs.validated(found))
    return a.description_audit(found, claims)


@check(
    "A22_new_observations",
    sql="""SELECT CASE event_type WHEN 'view' THEN 'public_post' WHEN 'click' THEN 'job_posting' WHEN 'signup' THEN 'profile_handle' WHEN 'purchase' THEN 'review' ELSE 'gossip' END AS signal_type,
      ['facebook', 'linkedin', 'google_places', 'news', 'myspace'][event_id % 5 + 1] AS platform, count(*) AS observations FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2""",
)
def new_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    before = rows.filter(F.pmod(F.substring("id", 5, 20).cast("bigint"), F.lit(3)) != 0)
    return discovery.new_observations(before, rows)


@check(
    "P25_reprojection_report",
    sql="""SELECT 'observations_by_platform' AS metric, ['facebook', 'linkedin', 'google_places', 'news', 'myspace'][event_id % 5 + 1] AS label, count(*) AS n FROM events GROUP BY 2
      UNION ALL SELECT 'companies', 'before', count(DISTINCT user_id) FROM events UNION ALL SELECT 'companies', 'after', count(DISTINCT user_id) FROM events
      UNION ALL SELECT 'companies', 'only_before', 0 UNION ALL SELECT 'companies', 'only_after', 0
      UNION ALL SELECT 'errors', 'all', count(*) FROM events WHERE event_type = 'error'""",
)
def reprojection_report(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    errors = rows.filter(F.array_contains("reasons", "unknown_signal"))
    return a.reprojection_report(rows, rows, errors)


