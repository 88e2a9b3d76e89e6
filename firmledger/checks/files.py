"""Checks that go through files: award and registry exports are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as m
from ..operators import observations as obs
from ..operators import site_surface as site
from ..session import fresh_folder
from ..sources import registry as reg
from ..sources.awards import normalize_award_rows, read_award_rows
from . import bindings as b
from .cohorts import _registry_rows
from .registry import check


def _export(rows: DataFrame, label: str, sep: str, encoding: str = "UTF-8") -> str:
    folder = fresh_folder(rows.sparkSession, label)
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "quoteAll": True, "encoding": encoding, "emptyValue": "", "lineSep": "\n"}
    rows.write.options(**options).csv(folder)
    return folder


def _broken_awards(spark: SparkSession, d: str) -> DataFrame:
    """Award rows whose support type holds a line break on every third row and quotes on every fifth."""
    kind, number = F.col(b.AWARD_HEADERS["measure_type"]), F.col(b.AWARD_HEADERS["measure_number"]).cast("bigint")
    text = F.when(number % 3 == 0, F.concat(kind, F.lit("\nlinje to; \n"))).when(number % 5 == 0, F.concat(F.lit('"'), kind, F.lit('" ;"x"'))).otherwise(kind)
    return b.award_rows(spark, d).withColumn(b.AWARD_HEADERS["measure_type"], text)


FILE_SQL = f"""SELECT measure_number, CASE WHEN {b.org_valid_sql("org")} THEN org ELSE '' END AS recipients, CAST(award_date AS VARCHAR) AS award_date,
  concat(whole, '.', part, '0000') AS amount,
  trim(regexp_replace(CASE WHEN o_orderkey % 3 = 0 THEN concat(measure_type, ' linje to; ') WHEN o_orderkey % 5 = 0 THEN concat('"', measure_type, '" ;"x"') ELSE measure_type END,
    '\\s+', ' ', 'g')) AS measure_type FROM award"""


def _read_awards(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize_award_rows(read_award_rows(spark, folder))
    return rows.select(
        "measure_number", F.array_join("recipient_orgs", ",").alias("recipients"), F.col("award_date").cast("string").alias("award_date"),
        F.col("amount").cast("string").alias("amount"), F.trim(F.regexp_replace("measure_type", r"\s+", " ")).alias("measure_type"),
    )


@check("S4_award_files", sql=b.with_ctes(b.AWARD_SQL, FILE_SQL))
def award_files(spark: SparkSession, d: str) -> DataFrame:
    """Semicolon files in UTF-8 with quoted line breaks, read by all tasks."""
    return _read_awards(spark, _export(_broken_awards(spark, d), "award-files", ";"))


@check("S5_award_files_in_utf16", sql=b.with_ctes(b.AWARD_SQL, FILE_SQL))
def award_files_in_utf16(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated files in UTF-16: the encoding and the separator are found from the head of the file."""
    return _read_awards(spark, _export(_broken_awards(spark, d), "award-files", "\t", "UTF-16LE"))


@check(
    "S1_registry_files",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, name, legal_form, CASE WHEN employees <> 7 THEN employees END AS employees, bankrupt, liquidating, municipality, coalesce(website, '') AS website
          FROM entity WHERE k % 2 = 1""",
    ),
)
def registry_files(spark: SparkSession, d: str) -> DataFrame:
    rows = reg.read_registry_bulk(spark, _export(_registry_rows(spark, d, 1), "registry-files", ","))
    return rows.select("org", "name", "legal_form", "employees", "bankrupt", "liquidating", "municipality", F.coalesce("website", F.lit("")).alias("website"))


@check(
    "S18_verified_observations",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, concat('reviewed-', k) AS id, sha256(org) AS content_sha256, concat('https://a.no/', k) AS source_url FROM entity WHERE k % 4 = 0""",
    ),
)
def verified_observations(spark: SparkSession, d: str) -> DataFrame:
    entities = b.entity(spark, d)
    number = F.col("org").cast("bigint") - b.ORG_BASE
    config = entities.filter(number % 4 == 0).select(
        "org", F.concat(F.lit("reviewed-"), number.cast("string")).alias("id"), F.sha2("org", 256).alias("content_sha256"),
        F.concat(F.lit("https://a.no/"), number.cast("string")).alias("source_url"),
    )
    return obs.build_verified(config, entities).select("org", "id", "content_sha256", "source_url")


@check(
    "J13_declaration_guard",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, c_custkey % 7 = 0 OR c_custkey % 5 IN (0, 2, 3) AS declared_ok FROM customer""",
)
def declaration_guard(spark: SparkSession, d: str) -> DataFrame:
    """Declared handles: the site's name and more, a foreign name, a bare number, both name words, and a name too short to be read."""
    key, number = F.col("c_custkey"), F.col("c_custkey").cast("string")
    shapes = [
        F.concat(F.lit("https://facebook.com/kunde"), number, F.lit("shop")), F.lit("https://facebook.com/zzzz"), F.lit("https://facebook.com/12345"),
        F.lit("https://instagram.com/handel.kunde"), F.lit("https://linkedin.com/company/kun"),
    ]
    url = F.element_at(F.array(*shapes), (key % 5 + 1).cast("int"))
    rows = b.table(spark, d, "customer").select(
        b.org_of("c_custkey").alias("org"), F.concat(F.lit("Kunde X"), number, F.lit(" Handel AS")).alias("_name"),
        F.concat(F.lit("https://kunde"), number, F.lit(".no/")).alias("final_url"),
        F.element_at(F.array(*map(F.lit, ("facebook", "facebook", "facebook", "instagram", "linkedin"))), (key % 5 + 1).cast("int")).alias("platform"),
        url.alias("url"), (key % 7 == 0).alias("publishable"),
    )
    return site.with_declaration_verdict(rows).select("org", "declared_ok")


@check(
    "J15_news_observations",
    sql="""WITH titles AS (SELECT doc_id, doc_id % 97 AS k, doc_id % 3 AS lead, doc_id % 2 AS paper FROM documents WHERE doc_id % 3 <> 2),
      once AS (SELECT CAST(n.p_partkey AS VARCHAR) AS org, lead, paper, min(doc_id) AS doc_id FROM titles JOIN part p ON p.p_partkey = titles.k
        JOIN part n ON lower(n.p_name) = lower(p.p_name) GROUP BY ALL)
      SELECT org, concat('https://avis.no/', doc_id) AS source_url FROM once QUALIFY row_number() OVER (PARTITION BY org ORDER BY doc_id) <= 2""",
)
def news_observations(spark: SparkSession, d: str) -> DataFrame:
    """Headlines of few companies by two papers: repeats once, the first two of each company."""
    part = b.table(spark, d, "part").select("p_partkey", "p_name")
    documents = b.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 97).alias("p_partkey")).join(part, "p_partkey")
    lead = F.element_at(F.array(F.lit(""), F.lit("Kort nytt fra "), F.lit("Store ")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    headlines = documents.select(
        "doc_id", F.concat(lead, F.initcap("p_name")).alias("title"), F.concat(F.lit("Avis "), (F.col("doc_id") % 2).cast("string")).alias("publisher"),
        F.concat(F.lit("https://avis.no/"), F.col("doc_id").cast("string")).alias("link"), F.lit(b.RETRIEVED_AT).alias("retrieved_at"), F.col("doc_id").alias("position"),
    )
    names = part.select(F.col("p_partkey").cast("string").alias("org"), F.col("p_name").alias("name"))
    found, members = m.name_mentions(names, headlines, "doc_id", "title")
    return m.news_observations(found, members, headlines, "doc_id", per_company=2).select("org", "source_url")
