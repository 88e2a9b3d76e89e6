"""Checks of page texts, markup dates, role cards and verified-site seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity as act
from ..operators import seeds as sd
from ..operators import site_surface as site
from ..sources import pages as src
from . import bindings as b
from . import pages as pg
from .registry import check

# --- S17 ---------------------------------------------------------------------------------------------


def seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """A seed per order: most companies have several, some addresses are relative, some companies are not in the registry."""
    key = F.col("o_orderkey")
    number = key.cast("string")
    return b.table(spark, d, "orders").select(
        F.when(key % 97 == 0, b.org_of("o_custkey", 900_000_000)).otherwise(b.org_of("o_custkey")).alias("org"),
        F.when(key % 5 == 0, F.concat(F.lit("www.seed"), number, F.lit(".no"))).otherwise(F.concat(F.lit(" https://seed"), number, F.lit(".no/"))).alias("website"),
        F.when(key % 7 == 0, F.lit("/proof")).when(key % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("http://proof.no/"), number)).alias("proof_url"),
        F.when(key % 3 == 0, F.concat(F.lit("sak "), number)).alias("proof"), key.alias("position"),
    )


SEED_SQL = """seed AS (
  SELECT CAST(CASE WHEN o_orderkey % 97 = 0 THEN 900000000 ELSE 800000000 END + o_custkey AS VARCHAR) AS org, o_orderkey AS position,
    CASE WHEN o_orderkey % 97 = 0 THEN 'unknown_company' WHEN o_orderkey % 5 = 0 THEN 'relative_website'
      WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'relative_proof' END AS broken FROM orders
), judged AS (
  SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN position < max(position) FILTER (WHERE broken IS NULL) OVER (PARTITION BY org) THEN 'repeated_seed' END AS rule FROM seed
)"""


@check(
    "S17_seeded_sites",
    sql=b.with_ctes(
        b.ENTITY_SQL, SEED_SQL,
        """SELECT e.org, CASE WHEN j.org IS NULL THEN e.website ELSE concat('https://seed', position, '.no/') END AS website,
          CASE WHEN j.org IS NOT NULL THEN 'independently_verified_exact_entity' END AS website_seed_source,
          CASE WHEN j.org IS NOT NULL THEN concat('http://proof.no/', position) END AS website_proof_url,
          CASE WHEN j.org IS NOT NULL THEN CASE WHEN position % 3 = 0 THEN concat('sak ', position) ELSE '' END END AS website_proof
        FROM entity e LEFT JOIN judged j ON j.org = e.org AND j.rule IS NULL""",
    ),
)
def seeded_sites(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = sd.apply_seeds(b.entity(spark, d), seed_rows(spark, d))
    return rows.select("org", "website", "website_seed_source", "website_proof_url", "website_proof")


@check("S17_seed_violations", sql=b.with_ctes(SEED_SQL, "SELECT org, rule, position FROM judged WHERE rule IS NOT NULL"))
def seed_violations(spark: SparkSession, d: str) -> DataFrame:
    _, broken = sd.apply_seeds(b.entity(spark, d), seed_rows(spark, d))
    return broken.select("org", "rule", "position")


# --- S15: texts --------------------------------------------------------------------------------------


def _plain_sql(html: str) -> str:
    """Visible text of a piece of html: no comments, a blank for every tag, entities read (as HTML does, also without semicolon), white space single."""
    bare = f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&copy", "©"), ("&middot", "·"), ("&amp", "&")):
        bare = f"regexp_replace({bare}, '{entity};?', '{sign}', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


@check(
    "S15_main_text",
    sql=b.with_ctes(
        pg.PAGE_SQL,
        f"""SELECT org, CASE WHEN ok THEN {_plain_sql("body")} END AS main_text FROM p""",
    ),
)
def main_text(spark: SparkSession, d: str) -> DataFrame:
    return pg.events(spark, d).select("org", "main_text")


@check(
    "S15_identity_text",
    sql=b.with_ctes(
        pg.PAGE_SQL,
        f"""SELECT org, CASE WHEN ok THEN trim(concat_ws(' ', CASE k % 4 WHEN 0 THEN concat('Ring ', k, ' eller ', k + 1) WHEN 1 THEN concat('Sted ', k) WHEN 2 THEN 'Firma' END,
          {_plain_sql("regexp_extract(raw_html, '(?s)<footer>(.*?)</footer>', 1)")})) END AS identity_text FROM p""",
    ),
)
def identity_text(spark: SparkSession, d: str) -> DataFrame:
    """The table's pages with a marked container before the article: by id, by class (nested), by item property, or none of these."""
    number = F.col("page_id").cast("string")
    box = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<div id="Kontakt-oss">Ring '), number, F.lit('<div class="contact"> eller <b>'), (F.col("page_id") + 1).cast("string"), F.lit("</b></div></div>")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('<section class="wide selskapsinfo-boks"><p>Sted<p>'), number, F.lit("</section>")))
        .when(F.col("page_id") % 4 == 2, F.lit('<span itemprop="legalName">Firma</span>'))
        .otherwise(F.lit('<div class="container">Ingen</div>'))
    )
    # Only the footer as the table has it: the planted footer lines have checks of their own.
    table = b.table(spark, d, "pages").select(pg.page_org().alias("org"), "page_id", F.replace(F.col("html"), F.lit("<article>"), F.concat(box, F.lit("<article>"))).alias("html"))
    snapshots = pg.page_snapshots(spark, d).drop("html", "page_id").join(table, "org")
    return src.page_events(snapshots).select("org", "identity_text")


# --- W12, P10, P11: markup -----------------------------------------------------------------------------------


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """The table's pages as news pages with dates in their markup, by page number."""
    kind = F.col("page_id") % 7
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    published = F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T08:00:00+01:00">'))
    head = (
        F.when(kind == 0, published)
        .when(kind == 1, F.concat(published, F.lit('<meta property="article:published_time" content="2023-05-05">')))
        .when(kind == 2, F.concat(F.lit('<meta name="pubdate" content="'), day, F.lit('"><meta itemprop="datePublished" content="2023-06-07">')))
        .when(kind == 3, F.concat(F.lit('<script type="application/ld+json">[{"@graph":{"@type":["NewsArticle"],"datePublished":"'), day, F.lit('"}}]</script>')))
        .otherwise(F.lit(""))
    )
    body = (
        F.when(kind == 4, F.concat(F.lit('<p>Sak <time datetime="'), day, F.lit('">4. mai 2020</time>')))
        .when(kind == 5, F.lit('<div class="post-date">Ute <span id="dato">05.02.2024</span></div><time>05.02.2024'))
        .when(kind == 0, F.lit('<div class="updated-date">1.1.2020</div>'))
        .otherwise(F.lit('<div class="candidate">1.1.2020</div>'))
    )
    html = F.replace(F.replace(F.col("html"), F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("<article>"), F.concat(body, F.lit("<article>")))
    return src.page_events(pg.page_snapshots(spark, d).withColumn("html", html).withColumn("status_code", F.lit(200)))


@check(
    "W12_markup_dates",
    sql="""SELECT CAST(810000000 + page_id AS VARCHAR) AS org,
        CASE page_id % 7 WHEN 2 THEN '2023-06-07' WHEN 5 THEN '2024-02-05' ELSE concat('2024-01-', lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0')) END AS date,
        CASE page_id % 7 WHEN 0 THEN 'meta_article_published_time' WHEN 2 THEN 'meta_itemprop_date_published' WHEN 3 THEN 'jsonld_newsarticle_date_published'
          WHEN 4 THEN 'time_datetime' ELSE 'date_labelled_element' END AS method
      FROM pages WHERE page_id % 7 IN (0, 2, 3, 4, 5)""",
)
def markup_dates(spark: SparkSession, d: str) -> DataFrame:
    found = marked_pages(spark, d)
    # The lone date of a text has a check of its own; here only markup counts.
    pages = found.select("org", F.col("final_url").alias("url"), F.lit("").alias("text"))
    return act.publication_dates(pages, src.date_candidates(found)).select("org", "date", "method")


@check(
    "P11_jobs_from_pages",
    sql=b.with_ctes(
        pg.PAGE_SQL,
        """SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), '/stillinger/selger-', k) AS url, 'Selger til lager' AS title, '2024-03-01' AS deadline,
            concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), CASE k % 3 WHEN 0 THEN '/sok?id=' ELSE '/stillinger/selger-' END, k) AS application_url
          FROM p WHERE k % 4 < 2
          UNION ALL SELECT org, concat('https://jobb.no/', k), 'Selger i butikk', '2024-03-01', concat('https://jobb.no/', k) FROM p WHERE k % 2 = 0""",
    ),
)
def jobs_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Role cards of careers pages, held against the company's name: from html to current jobs."""
    found = pg.careers_pages(spark, d)
    cards = site.job_cards(src.page_links(found), found).select(
        "*", F.lit(1).alias("source_order"), F.col("final_url").alias("source_url")
    )
    entities = b.table(spark, d, "pages").select(pg.page_org().alias("org"), F.lit("Kunde Handel AS").alias("name"))
    return act.current_jobs(cards, entities).select("org", "url", "title", F.col("deadline").cast("string").alias("deadline"), "application_url")
