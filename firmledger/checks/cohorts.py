"""Registry, manifest and sample checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.orgnum import digits
from ..operators import cohorts as c
from ..sources import registry as reg
from . import bindings as b
from .registry import check
from .scalars import STRATA_SQL

_SAMPLE = 200
_ENTITY_COLUMNS = "org, name, legal_form, employees, bankrupt, liquidating, municipality, website, latest_submitted_accounts"


def _registry_rows(spark: SparkSession, d: str, variant: int) -> DataFrame:
    """Half of the entity table in the shape of the registry export, under one of its two header variants."""
    half = b.entity(spark, d).filter(F.pmod(F.col("org").cast("bigint"), F.lit(2)) == variant)

    def cell(field: str):
        value = F.col(field).cast("string")
        if field == "employees":
            # Dirty counts must turn into null.
            return F.when(F.col("employees") == 7, F.lit("sju")).otherwise(value)
        if field in ("bankrupt", "liquidating"):
            return F.when(F.col(field), F.lit("TRUE")).otherwise(F.lit("false"))
        return value

    return half.select(*[cell(field).alias(names[variant]) for field, names in reg.REGISTRY_HEADERS.items()])


@check(
    "S1_S2_registry_rows",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, name, legal_form, CASE WHEN employees <> 7 THEN employees END AS employees, bankrupt, liquidating,
          municipality, municipality_number, industry_code, label AS industry_label, coalesce(website, '') AS website,
          latest_submitted_accounts FROM entity""",
    ),
)
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    halves = [reg.normalize_registry_rows(_registry_rows(spark, d, variant)) for variant in (0, 1)]
    return halves[0].unionByName(halves[1])


@check(
    "S3_manifest_problems",
    sql="""SELECT CAST(user_id AS VARCHAR) AS org, 'invalid organisation number' AS problem FROM events
      UNION ALL SELECT CAST(user_id AS VARCHAR), 'duplicate organisation number' FROM events GROUP BY user_id HAVING count(*) > 1""",
)
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    manifest = b.table(spark, d, "events").select(digits(F.concat(F.lit("NO "), F.col("user_id").cast("string"))).alias("org"))
    return reg.manifest_problems(manifest)


@check(
    "F1_eligible_filers",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        "SELECT org FROM entity WHERE latest_submitted_accounts = '2025' AND NOT bankrupt AND NOT liquidating",
    ),
)
def eligible_filers(spark: SparkSession, d: str) -> DataFrame:
    return c.eligible_filers(b.entity(spark, d), "2025").select("org")


@check(
    "F2_accounting_obligation",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, 'filing_observed' AS with_filing, CASE WHEN legal_form IN ('AS', 'ASA') THEN 'required_by_legal_form'
          WHEN legal_form IN ('ENK', 'SA') THEN 'threshold_or_activity_dependent' ELSE 'special_rule_or_review_required' END AS by_form
          FROM entity""",
    ),
)
def accounting_obligation(spark: SparkSession, d: str) -> DataFrame:
    return b.entity(spark, d).select(
        "org",
        c.accounting_obligation(F.col("legal_form"), F.col("latest_submitted_accounts")).alias("with_filing"),
        c.accounting_obligation(F.col("legal_form"), F.lit(None).cast("string")).alias("by_form"),
    )


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of all customers and of as many supplier keys that no registry row has."""
    known = b.table(spark, d, "customer").select(b.org_of("c_custkey").alias("org"))
    unknown = b.table(spark, d, "supplier").select(b.org_of("s_suppkey", 899_000_000).alias("org"))
    return known.unionByName(unknown)


@check(
    "J1_profiles_for_manifest",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, name, 'available' AS registry_status, 'filing_observed' AS accounting_obligation FROM entity
          UNION ALL SELECT CAST(899000000 + s_suppkey AS VARCHAR), NULL, 'not_found', NULL FROM supplier""",
    ),
)
def profiles_for_manifest(spark: SparkSession, d: str) -> DataFrame:
    return c.profiles_for_manifest(_manifest(spark, d), b.entity(spark, d)).select(
        "org", "name", "registry_status", "accounting_obligation"
    )


def _ordering_customers(spark: SparkSession, d: str, status: str) -> DataFrame:
    orders = b.table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
    return orders.select(b.org_of("o_custkey").alias("org"))


@check(
    "J4_disjoint_registry_cohort",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org FROM customer
          WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
            AND c_custkey IN (SELECT k FROM entity WHERE NOT bankrupt)""",
    ),
)
def disjoint_registry_cohort(spark: SparkSession, d: str) -> DataFrame:
    urgent = b.table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    excluded = urgent.select(b.org_of("o_custkey").alias("org"))
    registry = b.entity(spark, d).filter(~F.col("bankrupt"))
    return c.disjoint_cohort(_manifest(spark, d), excluded, registry)


@check(
    "J5_exclusion_chain",
    sql="""SELECT CAST(800000000 + o_custkey AS VARCHAR) AS org,
        CAST(min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) AS INTEGER) AS first_cohort, count(*) AS touches
      FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1""",
)
def exclusion_chain(spark: SparkSession, d: str) -> DataFrame:
    return c.exclusion_chain([_ordering_customers(spark, d, status) for status in ("F", "O", "P")])


SAMPLE_SQL = f"""marked AS (
  SELECT entity.*, k % 40 = 1 AS preserved FROM entity
  WHERE latest_submitted_accounts = '2025' AND NOT bankrupt AND NOT liquidating AND k % 11 <> 0
), chosen AS (
  SELECT * FROM marked ORDER BY preserved DESC,
    sha256(concat('20260825:', CASE WHEN preserved THEN 'preserved:' ELSE '' END, org)) LIMIT {_SAMPLE}
), sample AS (
  SELECT *, CASE WHEN preserved THEN 'preserved_eligible' ELSE 'financial_filer_population' END AS sample_slice,
    CASE WHEN row_number() OVER (ORDER BY sha256(concat('20260825:order:', org))) <= {_SAMPLE} * 0.6 THEN 'development'
      WHEN row_number() OVER (ORDER BY sha256(concat('20260825:order:', org))) <= {_SAMPLE} * 0.8 THEN 'validation'
      ELSE 'held_out' END AS evaluation_split
  FROM chosen
)"""


def _filer_sample(spark: SparkSession, d: str) -> DataFrame:
    e = b.entity(spark, d)
    key = F.col("org").cast("bigint") - b.ORG_BASE
    preserved = e.filter(F.pmod(key, F.lit(40)) == 1)
    excluded = e.filter(F.pmod(key, F.lit(11)) == 0)
    return c.filer_sample(e, _SAMPLE, "2025", preserved, excluded)


@check(
    "W3_filer_sample",
    sql=b.with_ctes(b.ENTITY_SQL, SAMPLE_SQL, "SELECT org, sample_slice, evaluation_split FROM sample"),
)
def filer_sample(spark: SparkSession, d: str) -> DataFrame:
    return _filer_sample(spark, d).select("org", "sample_slice", "evaluation_split")


@check(
    "W4_extension_holdout",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, 'extension_holdout' AS evaluation_split FROM entity WHERE k NOT IN (SELECT user_id FROM events)
          ORDER BY sha256(concat('20260824:', org)) LIMIT {_SAMPLE}""",
    ),
)
def extension_holdout(spark: SparkSession, d: str) -> DataFrame:
    excluded = b.table(spark, d, "events").select(b.org_of("user_id").alias("org"))
    return c.extension_sample(b.entity(spark, d), _SAMPLE, excluded).select("org", "evaluation_split")


@check(
    "W5_website_audit_sample",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, host FROM (
            SELECT org, website[5:] AS host, row_number() OVER (PARTITION BY website ORDER BY sha256(concat('20260823:', org))) AS rn
            FROM entity WHERE website IS NOT NULL AND NOT bankrupt AND website[5:] <> 'kunde3.example.no')
          WHERE rn = 1 ORDER BY sha256(concat('20260823:', org)) LIMIT {_SAMPLE}""",
    ),
)
def website_audit_sample(spark: SparkSession, d: str) -> DataFrame:
    e = b.entity(spark, d)
    hosts = e.filter(F.col("website") == "www.kunde3.example.no").select(F.lit("kunde3.example.no").alias("host")).distinct()
    return c.website_audit_sample(e, _SAMPLE, e.filter("bankrupt"), hosts).select("org", "host")


@check(
    "W6_stress_sample",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        STRATA_SQL,
        f"""population AS (SELECT * FROM strata ORDER BY sha256(concat('20260822:', org)) LIMIT {int(_SAMPLE * 0.7)}),
        rest AS (
          SELECT *, sha256(concat('20260822:stress:', org)) AS h,
            row_number() OVER (PARTITION BY stratum ORDER BY sha256(concat('20260822:stress:', org))) AS rn
          FROM strata WHERE org NOT IN (SELECT org FROM population)
        ), least_rows AS (
          SELECT greatest(1, least(3, {_SAMPLE - int(_SAMPLE * 0.7)} // count(DISTINCT stratum))) AS m FROM strata
        ), stress AS (
          SELECT rest.* FROM rest, least_rows
          ORDER BY rn <= m DESC, CASE WHEN rn <= m THEN stratum END NULLS FIRST, h LIMIT {_SAMPLE - int(_SAMPLE * 0.7)}
        )
        SELECT org, stratum, 'population' AS sample_slice FROM population
        UNION ALL SELECT org, stratum, 'stress' FROM stress""",
    ),
)
def stress_sample(spark: SparkSession, d: str) -> DataFrame:
    return c.stress_sample(b.entity(spark, d), _SAMPLE).select("org", "stratum", "sample_slice")


@check(
    "W7_seeded_batch",
    sql=b.with_ctes(
        b.ENTITY_SQL, f"SELECT org, 'entry' AS sample_slice FROM entity ORDER BY sha256(concat('20260823:', org)) LIMIT {_SAMPLE}"
    ),
)
def seeded_batch(spark: SparkSession, d: str) -> DataFrame:
    return c.seeded_batch(b.entity(spark, d), _SAMPLE, 20260823, "entry", "entry").select("org", "sample_slice")


@check(
    "A12_sample_counts",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        SAMPLE_SQL,
        STRATA_SQL.replace("FROM entity", "FROM sample"),
        """SELECT 'evaluation_split' AS dimension, evaluation_split AS label, count(*) AS companies FROM strata GROUP BY 2
          UNION ALL SELECT 'legal_form', legal_form, count(*) FROM strata GROUP BY 2
          UNION ALL SELECT 'stratum', filer_stratum, count(*) FROM strata GROUP BY 2""",
    ),
)
def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return c.sample_counts(_filer_sample(spark, d))


@check(
    "A12_membership_hash",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        SAMPLE_SQL,
        """leaves AS (SELECT org, row_number() OVER (ORDER BY org) - 1 AS pos, count(*) OVER () AS members FROM sample),
        parts AS (SELECT pos // 16 AS pos, sha256(string_agg(org, chr(10) ORDER BY pos)) AS digest, max(members) AS members FROM leaves GROUP BY pos // 16)
        SELECT max(members) AS selected, sha256(string_agg(digest, chr(10) ORDER BY pos)) AS selected_sha256 FROM parts""",
    ),
)
def membership_hash(spark: SparkSession, d: str) -> DataFrame:
    return c.membership_hash(_filer_sample(spark, d), fan=16)


@check(
    "A12_registry_hash",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """leaves AS (SELECT org, row_number() OVER (ORDER BY org) - 1 AS pos, count(*) OVER () AS members FROM entity),
        parts AS (SELECT pos // 1024 AS pos, sha256(string_agg(org, chr(10) ORDER BY pos)) AS digest, max(members) AS members FROM leaves GROUP BY pos // 1024)
        SELECT max(members) AS selected, sha256(string_agg(digest, chr(10) ORDER BY pos)) AS selected_sha256 FROM parts""",
    ),
)
def registry_hash(spark: SparkSession, d: str) -> DataFrame:
    """The same over every company: no sample, no single task."""
    return c.membership_hash(b.entity(spark, d).select("org"))
