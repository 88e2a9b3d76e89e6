"""Report-text, feed and activity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import all_text_dates, first_text_date
from ..functions.web import with_social_profile
from ..model import CLAIM, EVIDENCE, OBSERVATION, conform, empty
from ..operators import activity as act
from ..operators import audits
from ..operators import observations as obs
from ..operators import reports as rp
from ..operators.site_surface import contact_emails
from ..sources import feeds
from . import bindings as b
from .registry import check

DESCRIPTION = "Selskapet driver handel og salg av maskiner til industrien."


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Documents as annual reports: company number, workforce lines and an activity section are added by document number."""
    key, number = F.col("doc_id"), F.col("doc_id").cast("string")
    org = b.org_of("doc_id")
    lines = F.concat_ws(
        "\n",
        F.when(F.pmod(key, F.lit(3)) == 0, F.concat(F.lit("Antall ansatte er "), number)),
        F.when(F.pmod(key, F.lit(5)) == 0, F.concat(F.lit("Antall årsverk: "), number)),
        F.when(F.pmod(key, F.lit(7)) == 0, F.concat(F.lit("Antall årsverk: "), (key + 1).cast("string"))),
        F.when(F.pmod(key, F.lit(11)) == 0, F.lit("Konsernet har antall årsverk: 999")),
        F.when(F.pmod(key, F.lit(2)) == 0, F.lit("Virksomhetens art\n" + DESCRIPTION + "\nFortsatt drift\nForutsetningen er til stede")),
        F.when(F.pmod(key, F.lit(13)) != 0, F.concat(F.lit("Foretak "), org)),
    )
    return b.table(spark, d, "documents").select(
        org.alias("org"), "doc_id", F.concat("text", F.lit("\n"), lines).alias("text"), F.lit("https://accounts.example/copy").alias("source_url"),
        F.sha2(F.concat(number, F.lit("|"), "text"), 256).alias("content_sha256"), F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.lit("2024-12-31").alias("effective_at"),
    )


# A number above 100,000 is taken for a misreading, as the README says: the line that holds it states nothing.
_WORKFORCE_SQL = """w AS (
  SELECT k, CASE WHEN own AND next THEN 'conflicting_employee_counts' WHEN own OR next OR staff THEN 'accepted' ELSE 'no_employee_phrase' END AS status,
    CASE WHEN own AND next THEN NULL WHEN own THEN k WHEN next THEN k + 1 WHEN staff THEN k END AS value,
    CASE WHEN own AND next THEN NULL WHEN own OR next THEN 'full_time_equivalents' WHEN staff THEN 'employees' END AS measure
  FROM (SELECT doc_id AS k, doc_id % 5 = 0 AND doc_id <= 100000 AS own, doc_id % 7 = 0 AND doc_id + 1 <= 100000 AS next,
    doc_id % 3 = 0 AND doc_id <= 100000 AS staff FROM documents)
)"""


@check(
    "W13_workforce_phrases",
    sql=b.with_ctes(_WORKFORCE_SQL, "SELECT k AS doc_id, status AS workforce_status, CAST(value AS DOUBLE) AS workforce_value, measure AS workforce_measure FROM w"),
)
def workforce_phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = rp.extract_workforce(reports(spark, d))
    return rows.select("doc_id", "workforce_status", "workforce_value", "workforce_measure")


@check(
    "P5_workforce_observations",
    sql=b.with_ctes(_WORKFORCE_SQL, "SELECT CAST(800000000 + k AS VARCHAR) AS org, CAST(value AS VARCHAR) AS value FROM w WHERE status = 'accepted' AND k % 13 <> 0"),
)
def workforce_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = rp.workforce_observations(reports(spark, d), empty(spark, OBSERVATION))
    return rows.select("org", F.col("metrics")["workforce_value"].alias("value"))


@check(
    "W14_business_descriptions",
    sql=f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{DESCRIPTION}' END AS description,
      CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'no_company_activity_section' END AS description_status FROM documents""",
)
def business_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return rp.extract_description(reports(spark, d)).select("doc_id", "description", "description_status")


@check(
    "P6_report_claims",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        _WORKFORCE_SQL,
        f"""SELECT CAST(800000000 + k AS VARCHAR) AS org, 'external.workforce_snapshot' AS field, concat('{{"measure":"', measure, '","scope":"legal_entity","value":', value, '}}') AS value
          FROM w WHERE status = 'accepted' AND k % 13 <> 0
          UNION ALL SELECT CAST(800000000 + doc_id AS VARCHAR), 'company_description', '"{DESCRIPTION}"' FROM documents
            WHERE doc_id % 2 = 0 AND doc_id % 13 <> 0 AND doc_id IN (SELECT k FROM entity) AND doc_id % 4 <> 0""",
    ),
)
def report_claims(spark: SparkSession, d: str) -> DataFrame:
    texts = reports(spark, d)
    workforce, _ = rp.workforce_claims(obs.validated(rp.workforce_observations(texts, empty(spark, OBSERVATION))))
    # Every fourth company already has a description.
    held = texts.filter(F.pmod("doc_id", F.lit(4)) == 0).select("org", F.lit("company_description").alias("field"), F.lit("available").alias("availability"))
    described, _ = rp.annual_description_claims(
        conform(held, CLAIM), obs.validated(rp.description_observations(texts, b.entity(spark, d)))
    )
    return workforce.unionByName(described).select("org", "field", "value")


@check(
    "W18_text_contact_emails",
    sql="""SELECT doc_id, concat('a', doc_id, '@kunde.no,post@kunde.no') AS emails FROM documents""",
)
def text_contact_emails(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    text = F.concat(F.col("text"), F.lit("\nPost@kunde.no noreply@kunde.no x@annet.no a"), key, F.lit("@kunde.no "))
    rows = b.table(spark, d, "documents").select("doc_id", contact_emails(text, F.lit("https://www.kunde.no/")).alias("e"))
    own = F.filter("e", lambda email: email.rlike("^(?:a[0-9]+|post)@"))
    return rows.select("doc_id", F.array_join(own, ",").alias("emails"))


@check(
    "X14_text_dates",
    sql="""SELECT event_id, strftime(ts, '%Y-%m-%d') AS from_long, strftime(ts, '%Y-%m-%d') AS from_short, '2024-01-02' AS both_shapes FROM events""",
)
def text_dates(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return b.table(spark, d, "events").select(
        "event_id",
        first_text_date(F.concat(F.lit("Publisert "), F.date_format(ts, "d.M.yyyy"), F.lit(" av oss"))).alias("from_long"),
        first_text_date(F.concat(F.lit("Publisert "), F.date_format(ts, "dd/MM/yy"), F.lit(" av oss"))).alias("from_short"),
        F.array_join(all_text_dates(F.lit("Den 02.01.24 og 2024-01-02 og 2.1.2024")), ",").alias("both_shapes"),
    )


@check(
    "X9_social_profiles",
    sql="""SELECT event_id, CASE event_type WHEN 'view' THEN 'facebook' WHEN 'click' THEN 'linkedin' WHEN 'signup' THEN 'youtube' END AS platform,
      CASE event_type WHEN 'view' THEN concat('https://facebook.com/side', event_id) WHEN 'click' THEN concat('https://linkedin.com/company/firma', event_id)
        WHEN 'signup' THEN concat('https://youtube.com/@kanal', event_id) END AS url FROM events""",
)
def social_profiles(spark: SparkSession, d: str) -> DataFrame:
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat(F.lit("https://www.facebook.com/side"), key, F.lit("?ref=1")))
        .when(kind == "click", F.concat(F.lit("http://no.linkedin.com/company/firma"), key, F.lit("/about")))
        .when(kind == "signup", F.concat(F.lit("https://youtube.com/@kanal"), key, F.lit("/videos")))
        .when(kind == "purchase", F.lit("https://facebook.com/sharer/sharer.php"))
        .otherwise(F.lit("https://x.com/firma/status/1"))
    )
    rows = with_social_profile(b.table(spark, d, "events").select("event_id", "event_type"), raw)
    return rows.select("event_id", F.col("profile.platform").alias("platform"), F.col("profile.url").alias("url"))


def _feed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One RSS feed per company with orders: usable entry, repeat, foreign site, generic title, old and future entries."""
    customer = b.table(spark, d, "customer")
    number = F.col("c_custkey").cast("string")
    site = F.concat(F.lit("https://www.kunde"), number, F.lit(".no"))

    def item(title: F.Column | str, link: F.Column | str, date: str) -> F.Column:
        pieces = [F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit(f"</link><pubDate>{date}</pubDate></item>")]
        return F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])

    good = "Mon, 15 Jan 2024 10:00:00 +0100"
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'),
        item(F.concat(F.lit("Ny avtale "), number), F.concat(F.lit("/sak/"), number), good),
        item("Samme sak igjen", F.concat(site, F.lit("/sak/"), number), good),
        item("Ekstern sak her", "https://avis.no/sak", good),
        item("Nyheter", "/sak/generisk", good),
        item("Gammel sak her", "/sak/gammel", "Mon, 15 Jan 2018 10:00:00 +0100"),
        item("Fremtidig sak her", "/sak/fremtid", "Wed, 15 Jan 2031 10:00:00 +0100"),
        F.lit("</channel></rss>"),
    )
    broken = F.pmod("c_custkey", F.lit(10)) == 9
    return customer.select(
        b.org_of("c_custkey").alias("org"), F.concat(site, F.lit("/feed/")).alias("feed_url"), F.concat(site, F.lit("/")).alias("verified_url"),
        F.sha2(number, 256).alias("content_sha256"), F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.when(broken, F.lit("<rss><channel>")).otherwise(body).alias("body"),
    )


def feed_rows(spark: SparkSession, d: str) -> DataFrame:
    return feeds.current_entries(feeds.feed_entries(_feed_snapshots(spark, d)), "2024-02-01")


@check(
    "S14_feed_entries",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, concat('Ny avtale ', c_custkey) AS title,
      concat('https://www.kunde', c_custkey, '.no/sak/', c_custkey) AS url, '2024-01-15' AS published_date, 'feed_pubdate' AS date_method
      FROM customer WHERE c_custkey % 10 <> 9""",
)
def feed_entries(spark: SparkSession, d: str) -> DataFrame:
    return feed_rows(spark, d).select("org", "title", "url", "published_date", "date_method")


@check(
    "A19_feed_screen",
    sql="""SELECT count(*) AS sites, count(*) FILTER (WHERE c_custkey % 10 <> 9) AS sites_with_activity,
      count(*) FILTER (WHERE c_custkey % 10 <> 9) AS dated_updates FROM customer""",
)
def feed_screen(spark: SparkSession, d: str) -> DataFrame:
    rows = feed_rows(spark, d)
    tried = _feed_snapshots(spark, d).select("org", F.lit(0).alias("position"), F.col("feed_url").alias("url"))
    return feeds.feed_screen_summary(tried, feeds.feed_screen(tried, rows))


def _activity_pages(spark: SparkSession, d: str) -> DataFrame:
    customer = b.table(spark, d, "customer")
    number = F.col("c_custkey").cast("string")
    site = F.concat(F.lit("https://kunde"), number, F.lit(".no"))
    pages = F.array(
        F.struct(
            F.concat(site, F.lit("/nyheter/sak-"), number).alias("url"), F.concat(F.lit("Ny kontrakt "), number).alias("title"),
            F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit("Publisert 15.01.2024 i dag")).when(
                F.pmod("c_custkey", F.lit(3)) == 1, F.lit("Publisert 15.01.2024, endret 16.01.2024")
            ).otherwise(F.lit("Publisert 15.01.2031")).alias("main_text"),
        ),
        F.struct(
            F.concat(site, F.lit("/stillinger/selger-"), number).alias("url"), F.concat(F.lit("Selger til avdeling "), number).alias("title"),
            F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lit("Heltid. Søk nå.")).otherwise(F.lit("Om oss")).alias("main_text"),
        ),
        F.struct(F.concat(site, F.lit("/nyheter")).alias("url"), F.lit("Nyheter").alias("title"), F.lit("15.01.2024").alias("main_text")),
    )
    return customer.select(b.org_of("c_custkey").alias("org"), F.inline(pages)).select(
        "*", F.lit("").alias("identity_text"), F.sha2("url", 256).alias("content_sha256"), F.lit(False).alias("nominated")
    )


def _activity_sites(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "customer").select(
        b.org_of("c_custkey").alias("org"), F.concat(F.lit("https://kunde"), F.col("c_custkey").cast("string"), F.lit(".no/")).alias("final_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
    )


def _activity_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of the news pages' markup, by company number: a strong one, two strong ones that differ, or a weak one."""
    kind, number = F.pmod("c_custkey", F.lit(12)), F.col("c_custkey").cast("string")
    strong = F.struct(F.lit("meta_article_published_time").alias("method"), F.lit("2024-01-20T08:00:00").alias("raw"))
    other = F.struct(F.lit("jsonld_article_date_published").alias("method"), F.lit("2024-01-21").alias("raw"))
    weak = F.struct(F.lit("date_labelled_element").alias("method"), F.lit("17.01.2024").alias("raw"))
    offers = F.when(kind.isin(0, 6), F.array(weak, strong)).when(kind == 3, F.array(strong, other)).when(kind == 1, F.array(weak))
    url = F.concat(F.lit("https://kunde"), number, F.lit(".no/nyheter/sak-"), number)
    return b.table(spark, d, "customer").select(b.org_of("c_custkey").alias("org"), url.alias("url"), F.inline(offers))


@check(
    "P12_strict_activity",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, 'external.company_update' AS field, concat('https://kunde', c_custkey, '.no/nyheter/sak-', c_custkey) AS url,
          CASE c_custkey % 12 WHEN 9 THEN '2024-01-15' WHEN 1 THEN '2024-01-17' ELSE '2024-01-20' END AS published_date
        FROM customer WHERE c_custkey % 12 IN (0, 1, 6, 9)
      UNION ALL SELECT CAST(800000000 + c_custkey AS VARCHAR), 'external.job_posting', concat('https://kunde', c_custkey, '.no/stillinger/selger-', c_custkey), NULL
        FROM customer WHERE c_custkey % 2 = 0""",
)
def strict_activity(spark: SparkSession, d: str) -> DataFrame:
    pages, sites = _activity_pages(spark, d), _activity_sites(spark, d)
    claims, _ = act.activity_claims(act.strict_job_pages(pages, sites), act.strict_updates(pages, sites, _activity_dates(spark, d)))
    return claims.select(
        "org", "field", F.get_json_object("value", "$.url").alias("url"), F.get_json_object("value", "$.published_date").alias("published_date")
    )


@check(
    "W12_publication_dates",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, CASE c_custkey % 4 WHEN 0 THEN '2024-01-10' WHEN 1 THEN '2024-01-12' END AS date,
      CASE c_custkey % 4 WHEN 0 THEN 'meta_article_published_time' WHEN 1 THEN 'unambiguous_page_text' END AS method FROM customer WHERE c_custkey % 4 < 2""",
)
def publication_dates(spark: SparkSession, d: str) -> DataFrame:
    customer, kind = b.table(spark, d, "customer"), F.pmod("c_custkey", F.lit(4))
    org, url = b.org_of("c_custkey").alias("org"), F.lit("https://a.no/nyheter/x").alias("url")
    pages = customer.select(org, url, F.when(kind == 1, F.lit("Skrevet 2024-01-12")).otherwise(F.lit("Uten dato")).alias("text"))
    # A strong date beats a weak one; two strong days on one page make it abstain; the last kind has no date at all.
    strong = F.struct(F.lit("meta_article_published_time").alias("method"), F.lit("2024-01-10T08:00:00").alias("raw"))
    other = F.struct(F.lit("jsonld_article_date_published").alias("method"), F.lit("2024-01-11").alias("raw"))
    weak = F.struct(F.lit("time_text").alias("method"), F.lit("12.01.2024").alias("raw"))
    offers = F.when(kind == 0, F.array(weak, strong)).when(kind == 2, F.array(strong, other))
    candidates = customer.filter(kind.isin(0, 2)).select(org, url, F.inline(offers))
    return act.publication_dates(pages, candidates).select("org", "date", "method")


@check(
    "P13_feed_update_claims",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, concat('https://www.kunde', c_custkey, '.no/sak/', c_custkey) AS url, '2024-01-15' AS published_date
      FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 4 <> 0""",
)
def feed_update_claims(spark: SparkSession, d: str) -> DataFrame:
    entries = feed_rows(spark, d)
    sites = entries.select("org", F.col("verified_url").alias("final_url"), F.lit("{}").alias("identity_proof")).distinct()
    # Every fourth company already states the same update.
    stated = entries.filter(F.pmod(F.col("org").cast("bigint"), F.lit(4)) == 0).select(
        "org", F.lit(act.UPDATE_FIELD).alias("field"), F.to_json(F.struct("published_date", "title", "url")).alias("value")
    )
    claims, _ = act.feed_update_claims(entries, conform(stated, CLAIM), sites)
    return claims.select("org", F.get_json_object("value", "$.url").alias("url"), F.get_json_object("value", "$.published_date").alias("published_date"))


@check(
    "P11_J14_current_jobs",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, concat('https://jobb.no/', c_custkey) AS url, '2024-03-01' AS deadline FROM customer
      WHERE c_custkey % 3 = 0""",
)
def current_jobs(spark: SparkSession, d: str) -> DataFrame:
    kind, number = F.pmod("c_custkey", F.lit(3)), F.col("c_custkey").cast("string")
    customer = b.table(spark, d, "customer")
    entities = customer.select(b.org_of("c_custkey").alias("org"), F.concat(F.lit("Kunde"), number, F.lit(" Handel AS")).alias("name"))
    cards = customer.select(
        b.org_of("c_custkey").alias("org"), F.lit(0).alias("source_order"), F.lit("https://a.no").alias("source_url"), F.sha2(number, 256).alias("content_sha256"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"), F.lit("Selger butikk").alias("title"), F.concat(F.lit("https://jobb.no/"), number).alias("role_url"),
        F.lit("").alias("application_url"), F.when(kind == 1, F.lit("Frist 1.1.2024")).otherwise(F.lit("Frist 01.03.24")).alias("deadline_raw"),
        F.when(kind == 2, F.lit("Annet firma")).otherwise(F.concat(F.lit("Stilling hos Handel Kunde"), number)).alias("employer_context"),
        F.lit("").alias("hiring_organisation"),
    )
    rows = act.current_jobs(cards, entities)
    return rows.select("org", "url", F.col("deadline").cast("string").alias("deadline"))


def _guarded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One careers and one update claim per order with planted faults, sharing evidence in pairs."""
    orders = b.table(spark, d, "orders")
    key, number = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    org = b.org_of("o_custkey")
    evidence_id = F.concat(F.lit("ev-"), number)
    path = F.when(F.pmod(key, F.lit(4)) == 0, F.lit("karriere")).when(F.pmod(key, F.lit(4)) == 1, F.lit("bruker/karriere")).otherwise(F.lit("minkarriereside"))
    careers = orders.select(
        org.alias("org"), F.concat(F.lit("80|"), number).alias("claim_order"), F.lit(act.CAREERS_FIELD).alias("field"),
        F.concat(F.lit('{"anchor_text":null,"url":"https://a.no/'), path, F.lit('"}')).alias("value"), F.lit("available").alias("availability"),
        F.array(evidence_id).alias("evidence_ids"),
    )
    day = F.when(F.pmod(key, F.lit(3)) == 0, F.lit("2024-01-15")).when(F.pmod(key, F.lit(3)) == 1, F.lit("2031-01-15")).otherwise(F.lit("2024-01-15"))
    title = F.when(F.pmod(key, F.lit(3)) == 2, F.lit("Hello world!")).otherwise(F.lit("Ny avtale"))
    updates = orders.select(
        org.alias("org"), F.concat(F.lit("91|"), number).alias("claim_order"), F.lit(act.UPDATE_FIELD).alias("field"),
        F.concat(F.lit('{"published_date":"'), day, F.lit('","title":"'), title, F.lit('","url":"https://a.no/nyheter/x"}')).alias("value"),
        F.lit("available").alias("availability"), F.array(evidence_id).alias("evidence_ids"),
    )
    evidence = orders.select(org.alias("org"), evidence_id.alias("id"), F.lit(b.RETRIEVED_AT).alias("retrieved_at"))
    return conform(careers, CLAIM).unionByName(conform(updates, CLAIM)), conform(evidence, EVIDENCE)


@check(
    "F10_precision_guard",
    sql="""SELECT 'external.careers_page' AS what, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0
      UNION ALL SELECT 'external.company_update', count(*) FROM orders WHERE o_orderkey % 3 = 0
      UNION ALL SELECT 'evidence', count(*) FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0""",
)
def precision_guard(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = act.precision_guard(*_guarded(spark, d))
    kept = claims.groupBy(F.col("field").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(evidence.agg(F.lit("evidence").alias("what"), F.count(F.lit(1)).alias("n")).select("what", "n"))


@check(
    "U5_guard_replay",
    sql="""SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) + (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS removed, 0 AS added_or_changed""",
)
def guard_replay(spark: SparkSession, d: str) -> DataFrame:
    before, evidence = _guarded(spark, d)
    after, _ = act.precision_guard(before, evidence)
    return audits.guard_replay(before, after, ["org", "claim_order", "field", "value"])


@check(
    "J18_activity_provenance",
    sql="""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org, CASE WHEN c_custkey % 2 = 0 THEN 'proof' END AS identity_proof,
      CASE WHEN c_custkey % 2 = 0 THEN 'verified_same_site_dated_detail_page_v1' END AS extraction_method FROM customer WHERE c_custkey % 12 IN (0, 1, 6, 9)""",
)
def activity_provenance(spark: SparkSession, d: str) -> DataFrame:
    pages, sites = _activity_pages(spark, d), _activity_sites(spark, d)
    claims, evidence = act.activity_claims(
        act.strict_job_pages(pages, sites).filter(F.lit(False)), act.strict_updates(pages, sites, _activity_dates(spark, d))
    )
    even = F.pmod(F.col("org").cast("bigint"), F.lit(2)) == 0
    site_claims = sites.select(
        "org", F.lit("20|0").alias("claim_order"), F.lit("official_website").alias("field"),
        F.concat(F.lit('"'), F.col("final_url"), F.lit('"')).alias("value"), F.lit("available").alias("availability"),
        F.array(F.concat(F.lit("ev-site-"), F.col("org"))).alias("evidence_ids"),
    )
    site_evidence = sites.select(
        "org", F.concat(F.lit("ev-site-"), F.col("org")).alias("id"), F.col("final_url").alias("source_url"),
        F.when(even, F.lit("proof")).alias("identity_proof"),
    )
    rows = act.activity_provenance(
        claims.unionByName(conform(site_claims, CLAIM)), evidence.unionByName(conform(site_evidence, EVIDENCE))
    )
    return rows.filter(F.startswith("id", F.lit("ev-first"))).select("org", "identity_proof", "extraction_method")


