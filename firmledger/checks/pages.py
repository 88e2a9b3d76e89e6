"""Page, identity, candidate and site-surface checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import json_text
from ..functions.web import registered_domain, url_host
from ..operators import discovery as disc
from ..operators import identity as ident
from ..operators import observations as obs
from ..operators import site_surface as site
from ..sources import pages as src
from . import bindings as b
from . import records as rec
from .registry import check
from .stored import stored

SEEN = b.RETRIEVED_AT


def _key() -> F.Column:
    return F.col("page_id")


def page_org() -> F.Column:
    return (_key() + b.PAGE_ORG_BASE).cast("string")


def every_page(n: int, text: F.Column) -> F.Column:
    """A text on every n-th page."""
    return F.when(F.pmod(_key(), F.lit(n)) == 0, text).otherwise(F.lit(""))


def page_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The page table as fetched snapshots, with known links, body and footer lines added by page number."""
    key, number = _key(), _key().cast("string")
    host = url_host(F.col("url"))

    def every(n: int, text: F.Column, rest: int = 0) -> F.Column:
        return F.when(F.pmod(key, F.lit(n)) == rest, text).otherwise(F.lit(""))

    own = (key + b.PAGE_ORG_BASE).cast("string")
    links = F.concat(
        every(2, F.lit('<li><a href="/om-oss">Om oss</a></li>')),
        every(3, F.lit('<li><a href="/karriere/ledige-stillinger">Ledige stillinger</a></li>')),
        every(4, F.concat(F.lit('<li><a href="/nyheter/sak-'), number, F.lit('">Sak nummer '), number, F.lit("</a></li>"))),
        every(5, F.concat(F.lit('<li><a href="https://www.facebook.com/side'), number, F.lit('">Facebook</a></li>'))),
        every(6, F.lit('<li><a href="/personvern?a=1#b">Personvern</a></li>')),
    )
    footer = F.concat(
        F.when(F.pmod(key, F.lit(10)) == 0, F.concat(F.lit(" Org.nr: "), own)).otherwise(F.lit("")),
        F.when(F.pmod(key, F.lit(10)) == 5, F.lit(" Org.nr: 899999999")).otherwise(F.lit("")),
        every(7, F.concat(F.lit(" post@"), host)),
        every(8, F.lit(" 3 ledige stillinger")),
        every(9, F.lit(" Storgata 1, Lillehammerby")),
    )
    own_name = F.concat(company_name(), F.lit(" i "), municipality())
    body = F.concat(
        every(17, F.lit("<p>This domain is for sale.</p>"), 5),
        every(11, F.lit("<p>Nettsiden eies av Annet Selskap AS.</p>"), 3),
        every(13, F.concat(F.lit("<p>Firma "), own, F.lit("</p>")), 4),
        every(9, F.concat(F.lit("<p>"), own_name, F.lit(".</p>")), 5),
    )
    html = F.replace(F.col("html"), F.lit("<nav><ul>"), F.concat(F.lit("<nav><ul>"), links))
    html = F.replace(html, F.lit("<article>"), F.concat(F.lit("<article>"), body))
    html = F.replace(html, F.lit("</footer>"), F.concat(footer, F.lit("</footer>")))
    return b.table(spark, d, "pages").select(
        own.alias("org"), "page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"),
        F.when(F.pmod(key, F.lit(50)) == 49, F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.lit("homepage").alias("page_kind"), F.lit(SEEN).alias("retrieved_at"),
        html.alias("html"),
    )


def company_name() -> F.Column:
    """Named after the host, after the host with a stray word, or not at all."""
    labels = F.replace(F.replace(url_host(F.col("url")), F.lit("www."), F.lit("")), F.lit("."), F.lit(" "))
    words = F.initcap(F.regexp_replace(labels, " [a-z]+$", ""))
    return (
        F.when(F.pmod(_key(), F.lit(4)) == 3, F.concat(F.lit("Kunde Annet "), _key().cast("string"), F.lit(" AS")))
        .when(F.pmod(_key(), F.lit(4)) == 2, F.concat(words, F.lit(" Xyzzy AS")))
        .otherwise(F.concat(words, F.lit(" AS")))
    )


def municipality() -> F.Column:
    return F.when(F.pmod(_key(), F.lit(2)) == 0, F.lit("Lillehammerby")).otherwise(F.lit("Bergstad"))


def page_entities(spark: SparkSession, d: str) -> DataFrame:
    """One company per page."""
    return b.table(spark, d, "pages").select(
        (_key() + b.PAGE_ORG_BASE).cast("string").alias("org"), "page_id", company_name().alias("name"),
        municipality().alias("municipality"),
        F.concat(url_host(F.col("url")), F.lit("/")).alias("website"),
        F.when(F.pmod(_key(), F.lit(20)) == 0, F.lit("Eie og forvalte aksjer")).otherwise(F.lit("Handel")).alias("registry_purpose"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "page-events", lambda: src.page_events(page_snapshots(spark, d)))


PAGE_SQL = r"""raw AS (
  SELECT page_id AS k, CAST(810000000 + page_id AS VARCHAR) AS org, url,
    lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), ':[0-9]*$', '')) AS host,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title, html AS raw_html,
    array_to_string(string_split(host, '.')[-2:], '.') AS domain,
    page_id % 50 <> 49 AS ok,
    regexp_replace(replace(replace(host, 'www.', ''), '.', ' '), ' [a-z]+$', '') AS words,
    CASE k % 4 WHEN 3 THEN concat('kunde annet ', k) WHEN 2 THEN concat(words, ' xyzzy') ELSE words END AS low_name
  FROM pages
), p AS (
  SELECT *, replace(raw_html, '<article>', concat('<article>', CASE k % 17 WHEN 5 THEN '<p>This domain is for sale.</p>' ELSE '' END,
      CASE k % 11 WHEN 3 THEN '<p>Nettsiden eies av Annet Selskap AS.</p>' ELSE '' END, CASE k % 13 WHEN 4 THEN concat('<p>Firma ', org, '</p>') ELSE '' END,
      CASE k % 9 WHEN 5 THEN concat('<p>', array_to_string(list_transform(string_split(concat(low_name, ' as'), ' '), lambda w: CASE w WHEN 'as' THEN 'AS' ELSE concat(upper(w[1:1]), w[2:]) END), ' '),
        ' i ', CASE k % 2 WHEN 0 THEN 'Lillehammerby' ELSE 'Bergstad' END, '.</p>') ELSE '' END)) AS html,
    regexp_replace(regexp_extract(html, '(?s)<body>(.*?)(</body>|$)', 1), '(?s)<(nav|footer)>.*?</(nav|footer)>', ' ', 'g') AS body
  FROM raw
), named AS (
  SELECT p.*,
    list_filter(regexp_extract_all(low_name, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ('as','asa','ans','da','enk','iks','sa','sam','sti','stiftelsen',
      'nuf','ab','b','v','limited','ltd','inc','plc','the','og','and')) AS core,
    regexp_extract_all(host, '[a-z0-9]+') AS host_tokens
  FROM p
), overlap AS (
  SELECT *, len(list_distinct(list_filter(list_distinct(core), lambda t: list_contains(host_tokens, t) OR list_contains(footer_tokens, t)
      OR list_contains(title_tokens, t) OR list_contains(body_tokens, t)))) AS hits,
    list_has_all(host_tokens, core) OR list_has_all(footer_tokens, core) OR list_has_all(title_tokens, core) AS at_home
  FROM (SELECT *, regexp_extract_all(lower(regexp_extract(html, '<footer>(.*)</footer>', 1)), '[a-z0-9]+') AS footer_tokens,
    regexp_extract_all(lower(strip_accents(raw_title)), '[a-z0-9]+') AS title_tokens,
    regexp_extract_all(replace(lower(strip_accents(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>|&[a-z]+;', ' ', 'g'))), 'ß', ''), '[a-z0-9]+') AS body_tokens FROM named)
), assessed AS (
  SELECT *, CASE WHEN k % 17 = 5 THEN 0.1 WHEN k % 10 = 5 THEN 0.1 WHEN k % 10 = 0 THEN 1.0 WHEN k % 11 = 3 AND len(core) > 0 THEN 0.1 WHEN k % 13 = 4 THEN 1.0
      WHEN len(core) >= 2 AND at_home THEN 0.95
      WHEN hits >= 2 AND hits / len(list_distinct(core)) >= 0.75 THEN 0.85
      WHEN hits >= 2 AND hits / len(list_distinct(core)) >= 0.5 THEN 0.65 ELSE 0.3 END AS score
  FROM overlap WHERE ok
)"""


@check(
    "S15_page_events",
    sql=b.with_ctes(
        PAGE_SQL,
        r"""SELECT org, CASE WHEN ok THEN 'available' ELSE 'not_found' END AS status,
          CASE WHEN ok THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw_title, '\s+', ' ', 'g')), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') END AS title,
          CASE WHEN ok THEN len(regexp_extract_all(html, '<a href=')) + CASE WHEN contains(html, '<nav><ul>') THEN
            (k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 4 = 0)::INT + (k % 5 = 0)::INT + (k % 6 = 0)::INT ELSE 0 END ELSE 0 END AS links FROM p""",
    ),
)
def page_events(spark: SparkSession, d: str) -> DataFrame:
    rows = src.page_events(page_snapshots(spark, d))
    return rows.select("org", "status", "title", F.size("links").cast("bigint").alias("links"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Home pages as candidate sites, with their whole bodies."""
    return events(spark, d).filter(F.col("status") == "available").select(
        "org", F.col("org").alias("site_id"), "final_url", "registered_domain", "title", "description", "identity_text",
        "main_text", src.structured_names(F.col("jsonld")).alias("structured_names"), "content_sha256", "retrieved_at",
    )


def assessed(spark: SparkSession, d: str) -> DataFrame:
    return stored(
        spark, d, "assessed-sites",
        lambda: ident.assess_sites(ident.site_features(page_entities(spark, d), sites(spark, d))),
    )


@check("J6_website_identity", sql=b.with_ctes(PAGE_SQL, "SELECT org, score, score >= 0.9 AS publishable FROM assessed"))
def website_identity(spark: SparkSession, d: str) -> DataFrame:
    rows = ident.assess_sites(ident.site_features(page_entities(spark, d), sites(spark, d)))
    return rows.select("org", "score", "publishable")


@check(
    "P24_identity_gate_report",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT 'sites_by_status' AS metric, CASE WHEN score >= 0.9 THEN 'exact' WHEN score >= 0.8 THEN 'review' ELSE 'related_or_uncertain' END AS label,
          count(*) AS n FROM assessed GROUP BY 2
          UNION ALL SELECT 'quarantined_links', 'facebook', count(*) FROM assessed WHERE k % 5 = 0 AND contains(html, '<nav><ul>')""",
    ),
)
def identity_gate_report(spark: SparkSession, d: str) -> DataFrame:
    handles = ident.assess_handles(
        src.social_links(events(spark, d)).select("org", "platform", "url"), page_entities(spark, d)
    )
    _, quarantined = ident.gate_links(handles, assessed(spark, d))
    return ident.gate_report(assessed(spark, d), quarantined)


@check(
    "J12_social_handle_identity",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE WHEN k % 3 = 0 THEN 0.98 WHEN k % 3 = 1 THEN 0.9 ELSE 0.3 END AS identity_score, k % 3 <> 2 AS publishable FROM entity""",
    ),
)
def social_handle_identity(spark: SparkSession, d: str) -> DataFrame:
    # Handles: the whole name, its words in another order, or something else.
    number = (rec.key() + 100_000).cast("string")
    shape = F.pmod(rec.key(), F.lit(3))
    handle = (
        F.when(shape == 0, F.concat(F.lit("Kunde"), number, F.lit("Handel.no")))
        .when(shape == 1, F.concat(F.lit("handel-kunde-"), number))
        .otherwise(F.lit("zzz"))
    )
    links = b.entity(spark, d).select(
        "org", F.lit("facebook").alias("platform"), F.concat(F.lit("https://facebook.com/"), handle).alias("url")
    )
    return ident.assess_handles(links, plain_named(spark, d)).select("org", "identity_score", "publishable")


def plain_named(spark: SparkSession, d: str) -> DataFrame:
    """Entities under names of three distinctive words."""
    return b.entity(spark, d).withColumn("name", F.concat(F.lit("Kunde "), (rec.key() + 100_000).cast("string"), F.lit(" Handel AS")))


_SOURCES = ("registry", "registry_email", "guessed_domain", "search", "knowledge_graph", "hyphenated_domain")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Assessed sites spread over the six candidate sources."""
    number = F.col("org").cast("bigint") - b.PAGE_ORG_BASE
    source = F.element_at(F.array(*[F.lit(name) for name in _SOURCES]), (F.pmod(number, F.lit(6)) + 1).cast("int"))
    return assessed(spark, d).select(
        "*", source.alias("candidate_source"), F.col("registered_domain").alias("candidate_domain"),
        F.lit("47.11").alias("registry_code"), F.when(F.pmod(number, F.lit(20)) == 0, F.lit("Eie og forvalte aksjer")).otherwise(
            F.lit("Handel")
        ).alias("registry_purpose"),
    )


# Page facts of the planted data: own number on tenths and in every thirteenth body, the place in ninths' footers or bodies, the full
# name where footer, title or body spell it.
GATE_SQL = """facts AS (
  SELECT *, k % 10 = 0 OR k % 13 = 4 AS own, len(core) > 0 AND (list_has_all(footer_tokens, legal) OR list_has_all(title_tokens, legal) OR list_has_all(body_tokens, legal)) AS full_name,
    k % 9 = 0 AND k % 2 = 0 OR k % 9 = 5 AS place, list_contains(legal, 'example') AS partial
  FROM (SELECT *, list_filter(regexp_extract_all(low_name, '[a-z0-9]+'), lambda t: t NOT IN ('as','asa','ans','da','enk','iks','sa','sam','sti','stiftelsen','nuf','ab','limited','ltd','inc','plc')) AS legal FROM assessed)
), gated AS (
  SELECT org, k, url, ['registry', 'registry_email', 'guessed_domain', 'search', 'knowledge_graph', 'hyphenated_domain'][k % 6 + 1] AS candidate_source,
    CASE WHEN score < 0.9 THEN false
      WHEN k % 6 = 0 THEN true
      WHEN own THEN true
      WHEN k % 6 = 1 THEN full_name AND partial AND place
      ELSE full_name AND place END AS publishable
  FROM facts
)"""


@check("J7_J8_J9_candidate_gates", sql=b.with_ctes(PAGE_SQL, GATE_SQL, "SELECT org, candidate_source, publishable FROM gated"))
def candidate_gates(spark: SparkSession, d: str) -> DataFrame:
    return disc.run_gates(candidates(spark, d)).select("org", "candidate_source", "publishable")


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """Gated candidates where companies share sites: twelve pages offer themselves to one company."""
    number = F.col("org").cast("bigint") - b.PAGE_ORG_BASE
    gated = stored(spark, d, "gated-sites", lambda: disc.run_gates(candidates(spark, d)))
    return gated.withColumn("org", F.floor(number / 12).cast("string"))


@check(
    "W10_website_waterfall",
    sql=b.with_ctes(
        PAGE_SQL,
        GATE_SQL,
        """ranked AS (
          SELECT CAST(k // 12 AS VARCHAR) AS org, candidate_source, url AS final_url, publishable,
            row_number() OVER (PARTITION BY k // 12 ORDER BY NOT publishable, k % 6, url) AS rn
          FROM gated WHERE publishable OR candidate_source = 'registry')
        SELECT org, candidate_source, final_url, publishable FROM ranked WHERE rn = 1""",
    ),
)
def website_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return disc.choose_site(_offered(spark, d)).select("org", "candidate_source", "final_url", "publishable")


@check(
    "A22_site_gain",
    sql=b.with_ctes(
        PAGE_SQL,
        GATE_SQL,
        """old AS (SELECT DISTINCT k // 12 AS o FROM gated WHERE publishable AND candidate_source = 'registry'),
        new AS (SELECT o, arg_min(candidate_source, rank) AS candidate_source FROM (
          SELECT k // 12 AS o, candidate_source, concat(k % 6, url) AS rank FROM gated WHERE publishable) GROUP BY o)
        SELECT CASE WHEN old.o IS NULL THEN 'gained' ELSE 'kept' END AS state, candidate_source AS source, count(*) AS companies
        FROM new LEFT JOIN old ON new.o = old.o GROUP BY 1, 2""",
    ),
)
def site_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = _offered(spark, d)
    before = disc.choose_site(rows.filter(F.col("candidate_source") == "registry"))
    return disc.site_gain_summary(disc.site_gain(before, disc.choose_site(rows)))


@check(
    "F14_unresolved_entities",
    sql=b.with_ctes(b.ENTITY_SQL, "SELECT org FROM entity WHERE website IS NULL AND NOT (k % 5 = 1)"),
)
def unresolved_entities(spark: SparkSession, d: str) -> DataFrame:
    entities = b.entity(spark, d)
    found = entities.select("org", (F.pmod(rec.key(), F.lit(5)) == 1).alias("publishable"))
    return disc.unresolved_entities(entities, found).select("org")


@check(
    "W11_unambiguous_candidates",
    sql="""SELECT CAST(800000000 + user_id AS VARCHAR) AS org, CASE WHEN count(DISTINCT item) = 1 AND count(DISTINCT side) = 1 THEN 'candidate' ELSE 'ambiguous' END AS state,
      CASE WHEN count(DISTINCT item) = 1 AND count(DISTINCT side) = 1 THEN min(item) END AS item
      FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN event_type ELSE 'type' || user_id % 5 END AS item,
              CASE WHEN user_id % 4 = 0 THEN event_id % 2 ELSE user_id % 2 END AS side FROM events) e GROUP BY user_id""",
)
def unambiguous_candidates(spark: SparkSession, d: str) -> DataFrame:
    # Every event binds an item and a website; two in three companies keep one item, three in four one website.
    user, event = F.col("user_id"), F.col("event_id")
    item = F.when(user % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("type"), (user % 5).cast("string")))
    side = F.when(user % 4 == 0, event % 2).otherwise(user % 2)
    bindings = b.table(spark, d, "events").select(
        b.org_of("user_id").alias("org"), item.alias("item"), F.concat(F.lit("www.side"), side.cast("string"), F.lit(".no")).alias("website")
    )
    return disc.unambiguous_candidates(bindings).select("org", "state", "item")


@check(
    "F11_email_domain_candidates",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, website IS NULL AND k % 4 IN (1, 2) AS eligible,
          CASE WHEN website IS NOT NULL THEN 'registry_website_present' WHEN k % 4 = 0 THEN 'registry_email_missing_or_invalid'
            WHEN k % 4 = 3 THEN 'only_generic_email_domains' ELSE 'candidate_domains_from_registry_email' END AS reason,
          CASE WHEN website IS NULL AND k % 4 IN (1, 2) THEN concat('kunde', k, '.no') END AS domain FROM entity""",
    ),
)
def email_domain_candidates(spark: SparkSession, d: str) -> DataFrame:
    number = rec.key().cast("string")
    email = (
        F.when(F.pmod(rec.key(), F.lit(4)) == 0, F.lit("ingen adresse"))
        .when(F.pmod(rec.key(), F.lit(4)) == 3, F.lit("eier@Gmail.com"))
        .otherwise(F.concat(F.lit("<post@Kunde"), number, F.lit(".NO>; eier@gmail.com, x@kunde"), number, F.lit(".no")))
    )
    return disc.email_domain_candidates(b.entity(spark, d).withColumn("email", email))


@check(
    "F12_domain_candidates",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """t AS (SELECT org, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: t NOT IN ('as', 'asa', 'enk', 'sa')) AS t FROM entity)
        SELECT org, 'legal_name_compact' AS strategy, concat(array_to_string(t, ''), '.no') AS domain FROM t
        UNION ALL SELECT org, 'legal_name_hyphenated', concat(array_to_string(t, '-'), '.no') FROM t""",
    ),
)
def domain_candidates(spark: SparkSession, d: str) -> DataFrame:
    return disc.domain_candidates(b.entity(spark, d)).select("org", "strategy", "domain")


def _search_results(spark: SparkSession, d: str) -> DataFrame:
    """Three results per company: a register page, a named page without number, and its own site."""
    entities = plain_named(spark, d)
    number = rec.key().cast("string")
    own_site = F.concat(F.lit("https://kunde"), (rec.key() + 100_000).cast("string"), F.lit("handel.no/"))
    rows = F.array(
        F.struct(
            F.concat(F.lit("https://www.proff.no/selskap/"), F.col("org")).alias("url"), F.col("name").alias("title"),
            F.col("org").alias("snippet"), F.lit(1).alias("rank"),
        ),
        F.struct(
            F.concat(F.lit("https://avis.no/sak/"), number).alias("url"), F.col("name").alias("title"), F.col("municipality").alias("snippet"),
            F.lit(2).alias("rank"),
        ),
        F.struct(
            own_site.alias("url"), F.when(F.pmod(rec.key(), F.lit(2)) == 0, F.col("name")).otherwise(F.lit("Velkommen")).alias("title"),
            F.when(F.pmod(rec.key(), F.lit(3)) == 0, F.concat(F.lit("Org "), F.col("org"))).otherwise(F.lit("Hjem")).alias("snippet"),
            F.lit(3).alias("rank"),
        ),
    )
    return entities.select("org", F.inline(rows))


_SEARCH_SQL = """s AS (
  SELECT org, k, 1 AS rank, 0.0 AS score, false AS accepted FROM entity
  UNION ALL SELECT org, k, 2, 0.55, false FROM entity
  UNION ALL SELECT org, k, 3, least(1.0, CASE WHEN k % 3 = 0 THEN 0.75 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.45 ELSE 0 END + 0.3), k % 3 = 0 OR k % 2 = 0 FROM entity
)"""


@check(
    "J10_search_scores",
    sql=b.with_ctes(b.ENTITY_SQL, _SEARCH_SQL, "SELECT org, CAST(rank AS INTEGER) AS rank, round(score, 2) AS score, accepted AND score >= 0.75 AS publishable_candidate FROM s"),
)
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = disc.score_search_results(_search_results(spark, d), plain_named(spark, d))
    return scored.select("org", "rank", F.round("score", 2).alias("score"), "publishable_candidate")


@check(
    "W8_best_search_result",
    sql=b.with_ctes(b.ENTITY_SQL, """SELECT org, NOT (k % 2 = 0 OR k % 3 = 0) AS abstained FROM entity"""),
)
def best_search_result(spark: SparkSession, d: str) -> DataFrame:
    entities = plain_named(spark, d)
    scored = disc.score_search_results(_search_results(spark, d), entities)
    return disc.best_search_result(scored, entities).select("org", "abstained")


# --- site surface ------------------------------------------------------------------------------------------

def links(spark: SparkSession, d: str) -> DataFrame:
    return src.page_links(events(spark, d))


def verified(spark: SparkSession, d: str) -> DataFrame:
    return assessed(spark, d).filter("publishable").select(
        "org", "final_url", "content_sha256", "retrieved_at", "identity_text", "score"
    )


_NAV = "ok AND contains(html, '<nav><ul>')"


@check(
    "W17_careers_links",
    sql=b.with_ctes(
        PAGE_SQL,
        f"""SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), '/karriere/ledige-stillinger') AS url, 'karriere' AS marker
          FROM p WHERE {_NAV} AND k % 3 = 0""",
    ),
)
def careers_links(spark: SparkSession, d: str) -> DataFrame:
    return site.careers_links(links(spark, d)).select("org", "url", "marker")


@check(
    "W17_news_links",
    sql=b.with_ctes(
        PAGE_SQL,
        f"""SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), '/nyheter/sak-', k) AS url, 'nyheter' AS marker,
          concat('Sak nummer ', k) AS anchor_text FROM p WHERE {_NAV} AND k % 4 = 0""",
    ),
)
def news_links(spark: SparkSession, d: str) -> DataFrame:
    return site.news_links(links(spark, d)).select("org", "url", "marker", "anchor_text")


@check(
    "W17_identity_links",
    sql=b.with_ctes(
        PAGE_SQL,
        f"""SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), path) AS url, CAST(row_number() OVER (PARTITION BY org ORDER BY r) AS INTEGER) AS pick
          FROM (SELECT org, url, '/personvern' AS path, 0 AS r FROM p WHERE {_NAV} AND k % 6 = 0
            UNION ALL SELECT org, url, '/om-oss', 15 FROM p WHERE {_NAV} AND k % 2 = 0)""",
    ),
)
def identity_links(spark: SparkSession, d: str) -> DataFrame:
    # The table's own links are random words that hold none of the terms; all links take part.
    return site.identity_links(links(spark, d)).select("org", "url", "pick")


@check(
    "W17_priority_links",
    sql=b.with_ctes(
        PAGE_SQL,
        f"""SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), path) AS url FROM (
          SELECT org, url, '/om-oss' AS path FROM p WHERE {_NAV} AND k % 2 = 0
          UNION ALL SELECT org, url, concat('/nyheter/sak-', k) FROM p WHERE {_NAV} AND k % 4 = 0)""",
    ),
)
def priority_links(spark: SparkSession, d: str) -> DataFrame:
    return site.priority_links(links(spark, d)).select("org", "url")


@check(
    "P9_careers_claims",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), '/karriere/ledige-stillinger') AS careers_url, score AS confidence
          FROM assessed WHERE score >= 0.9 AND k % 3 = 0 AND contains(html, '<nav><ul>')""",
    ),
)
def careers_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = site.careers_claims(site.careers_links(links(spark, d)), verified(spark, d))
    return claims.select("org", F.get_json_object("value", "$.url").alias("careers_url"), "confidence")


def handle_rows(spark: SparkSession, d: str) -> DataFrame:
    found = src.social_links(events(spark, d)).select(
        "org", "final_url", "content_sha256", "origin", "platform", "url", F.lit(True).alias("single_page")
    )
    return site.handle_observations(ident.assess_handles(found, page_entities(spark, d)), page_entities(spark, d), verified(spark, d))


@check("P7_declared_handles", sql=b.with_ctes(PAGE_SQL, "SELECT org, host AS profile_url FROM p WHERE false"))
def declared_handles(spark: SparkSession, d: str) -> DataFrame:
    # Side handles fit neither the site nor the name: all of them are refused.
    return handle_rows(spark, d).select("org", "profile_url")


def fitting_handles(spark: SparkSession, d: str) -> DataFrame:
    """Each verified site declares a page named after its own host label."""
    brand = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url_host(F.col("final_url")), r"^www\.", ""), r"\."), 1), "[^a-z0-9]", "")
    found = verified(spark, d).select(
        "org", "final_url", "content_sha256", F.lit("link").alias("origin"), F.lit("facebook").alias("platform"),
        F.concat(F.lit("https://facebook.com/"), brand, F.lit("norge")).alias("url"), F.lit(True).alias("single_page"),
    )
    return site.handle_observations(ident.assess_handles(found, page_entities(spark, d)), page_entities(spark, d), verified(spark, d))


@check(
    "P7_P8_fitting_handles",
    sql=b.with_ctes(
        PAGE_SQL,
        r"""f AS (SELECT org, score, regexp_replace(string_split(regexp_replace(host, '^www\.', ''), '.')[1], '[^a-z0-9]', '', 'g') AS brand FROM assessed WHERE score >= 0.9)
        SELECT org, concat('https://facebook.com/', brand, 'norge') AS profile_url, score AS confidence FROM f WHERE length(brand) >= 4""",
    ),
)
def fitting_handle_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = site.handle_claims(obs.validated(fitting_handles(spark, d)))
    rows = claims.filter(F.col("field") == "external.profile_handle")
    brand = F.regexp_extract(json_text(F.col("value")), r"facebook\.com/(.*)norge$", 1)
    # Shorter labels pass only by the legal name, which the host rule of the names makes likely.
    return rows.filter(F.length(brand) >= 4).select("org", json_text(F.col("value")).alias("profile_url"), "confidence")


@check(
    "W18_P8_contact_emails",
    sql=b.with_ctes(
        PAGE_SQL, "SELECT org, concat('post@', host) AS email, score AS confidence FROM assessed WHERE score >= 0.9 AND k % 7 = 0 AND contains(html, '</footer>')"
    ),
)
def contact_emails(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = site.contact_claims(obs.validated(site.contact_observations(verified(spark, d))))
    return claims.select("org", json_text(F.col("value")).alias("email"), "confidence")


@check(
    "P10_vacancy_counts",
    sql=b.with_ctes(PAGE_SQL, "SELECT org, 3 AS vacancies FROM p WHERE ok AND k % 8 = 0 AND contains(html, '</footer>')"),
)
def vacancy_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("org", site.vacancy_count(F.concat_ws(" ", "main_text", "identity_text")).alias("vacancies"))
    return rows.filter(F.col("vacancies") > 0)


def careers_pages(spark: SparkSession, d: str) -> DataFrame:
    """Careers pages around the table's own pages: cards of several shapes, and a posting on every second page."""
    number = _key().cast("string")
    posting = every_page(
        2,
        F.concat(
            F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Selger i butikk","validThrough":"2024-03-01","url":"https://jobb.no/'),
            number, F.lit('","hiringOrganization":{"name":"Kunde Handel"}}</script>'),
        ),
    )
    apply = every_page(3, F.concat(F.lit('<p><a href="/sok?id='), number, F.lit('">Søk nå</a>')))
    employer = F.when(F.pmod(_key(), F.lit(4)) < 2, F.lit("hos Kunde Handel")).otherwise(F.lit("hos noen andre"))
    body = F.concat(
        F.lit('<html><body><div class="side">'), posting, F.lit('<ul><li><div><h3><a href="/stillinger/selger-'), number, F.lit('">Selger til lager</a></h3><p>'), employer,
        F.lit("<p>Frist 01.03.2024"), apply, F.lit('</div><li><a href="/stillinger/uten-dato">Leder uten dato</a></li>'),
        # Generic, outside a careers section, two roles around one date, and a whole card in one anchor.
        F.lit('<li><a href="/stillinger">Ledige stillinger</a> 01.03.2024<li><a href="/om/selger-to">Selger nummer to</a> 01.03.2024</ul>'),
        F.lit('<section>Frist 02.03.2024 <a href="/jobb/kokk-a">Kokk en</a> <a href="/jobb/kokk-b">Kokk to</a></section>'),
        F.lit('<article><a href="/karriere/jobb/butikk-sjef/">Butikk-sjef Bergen Kunde Handel 05.03.2023</a></article></div></body></html>'),
    )
    return src.page_events(page_snapshots(spark, d).withColumn("html", body).withColumn("status_code", F.lit(200)))


@check(
    "P10_job_cards",
    sql=b.with_ctes(
        PAGE_SQL,
        """site AS (SELECT org, k, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS home FROM p)
          SELECT org, 'dated_role_card' AS method, 'Selger til lager' AS title, concat(home, '/stillinger/selger-', k) AS role_url, '01.03.2024' AS deadline_raw,
            concat(home, CASE k % 3 WHEN 0 THEN '/sok?id=' ELSE '/stillinger/selger-' END, k) AS application_url,
            CASE k % 3 WHEN 0 THEN 'explicit_apply_link' ELSE 'role_detail_link' END AS action_type,
            concat('Selger til lager hos ', CASE WHEN k % 4 < 2 THEN 'Kunde Handel' ELSE 'noen andre' END, ' Frist 01.03.2024', CASE k % 3 WHEN 0 THEN ' Søk nå' ELSE '' END) AS employer_context FROM site
          UNION ALL SELECT org, 'dated_role_card', 'Butikk-sjef Bergen Kunde Handel 05.03.2023', concat(home, '/karriere/jobb/butikk-sjef/'), '05.03.2023',
            concat(home, '/karriere/jobb/butikk-sjef/'), 'role_detail_link', 'Butikk-sjef Bergen Kunde Handel 05.03.2023' FROM site
          UNION ALL SELECT org, 'jsonld_job_posting', 'Selger i butikk', concat('https://jobb.no/', k), '2024-03-01', concat('https://jobb.no/', k), 'structured_job_posting', 'Kunde Handel'
            FROM site WHERE k % 2 = 0""",
    ),
)
def job_cards(spark: SparkSession, d: str) -> DataFrame:
    found = careers_pages(spark, d)
    return site.job_cards(src.page_links(found), found).select(
        "org", "method", "title", "role_url", "deadline_raw", "application_url", "action_type", "employer_context"
    )


@check(
    "U7_missing_seed_events",
    sql=b.with_ctes(PAGE_SQL, "SELECT org, concat('https://', host, '/') AS requested_url, 'source_error' AS status FROM p WHERE k % 5 = 4"),
)
def missing_seed_events(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("org").cast("bigint") - b.PAGE_ORG_BASE
    delivered = events(spark, d).filter(F.pmod(number, F.lit(5)) != 4)
    return site.missing_seed_events(page_entities(spark, d), delivered).select("org", "requested_url", "status")


def grouped_events(spark: SparkSession, d: str) -> DataFrame:
    """Seven pages per company: the first three are home pages of different days."""
    number = F.col("org").cast("bigint") - b.PAGE_ORG_BASE
    place = F.pmod(number, F.lit(7))
    return events(spark, d).select(
        F.floor(number / 7).cast("string").alias("org"), "final_url", "requested_url", "status", "error", "content_sha256", "title",
        F.when(place < 3, F.lit("homepage")).otherwise(F.lit("subpage")).alias("page_kind"),
        F.concat(F.lit("2024-02-0"), (place + 1).cast("string"), F.lit("T00:00:00Z")).alias("retrieved_at"),
    )


@check(
    "A20_crawl_summary",
    sql=b.with_ctes(
        PAGE_SQL,
        """g AS (SELECT CAST(k // 7 AS VARCHAR) AS org, k % 7 AS place, url, ok FROM p)
        SELECT org, coalesce(max_by(CASE WHEN ok THEN 'available' ELSE 'not_found' END, place) FILTER (WHERE place < 3), 'not_found') AS status,
          max_by(url, place) FILTER (WHERE place < 3) AS final_url, count(DISTINCT url) FILTER (WHERE ok) AS pages,
          count(*) FILTER (WHERE NOT ok) AS errors FROM g GROUP BY org""",
    ),
)
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = grouped_events(spark, d)
    return site.crawl_summary(rows.select("org").distinct(), rows).select("org", "status", "final_url", "pages", "errors")


@check(
    "A20_unique_pages",
    sql=b.with_ctes(PAGE_SQL, "SELECT CAST(k // 7 AS VARCHAR) AS org, count(DISTINCT url) AS pages FROM p WHERE ok GROUP BY 1"),
)
def unique_pages(spark: SparkSession, d: str) -> DataFrame:
    return site.unique_pages(grouped_events(spark, d)).groupBy("org").agg(F.count(F.lit(1)).alias("pages"))


@check(
    "A21_site_activity",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT org, 'Site with 1 pages and 0 checked profiles.' AS evidence_span FROM assessed WHERE score >= 0.9""",
    ),
)
def site_activity(spark: SparkSession, d: str) -> DataFrame:
    none = src.social_links(events(spark, d)).filter(F.lit(False))
    return site.site_activity(verified(spark, d), events(spark, d).filter(F.col("status") == "available"), none).select("org", "evidence_span")


@check(
    "A21_site_news",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT org, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), '/nyheter/2024/sak') AS source_url FROM assessed WHERE score >= 0.9""",
    ),
)
def site_news(spark: SparkSession, d: str) -> DataFrame:
    origin = F.regexp_extract("final_url", "^[a-zA-Z]+://[^/?#]*", 0)
    news = events(spark, d).filter(F.col("status") == "available").select(
        "org", F.explode(F.array(F.concat(origin, F.lit("/nyheter")), F.concat(origin, F.lit("/nyheter/2024/sak")), origin)).alias("final_url"),
        "title", "content_sha256",
    )
    return site.site_news(verified(spark, d), news).select("org", "source_url")


@check(
    "F13_feed_candidates",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT org, CAST(position AS INTEGER) AS position, concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*'), path) AS url
          FROM assessed, (VALUES (0, '/feed/'), (1, '/rss.xml'), (2, '/feed.xml'), (3, '/atom.xml')) f(position, path) WHERE score >= 0.9""",
    ),
)
def feed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return site.feed_candidates(verified(spark, d))


@check(
    "W10_secondary_pages",
    sql=b.with_ctes(
        PAGE_SQL,
        """SELECT org, concat('https://', domain, '/kontakt') AS page FROM p WHERE ok AND k % 2 = 0""",
    ),
)
def secondary_pages(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("org").cast("bigint") - b.PAGE_ORG_BASE
    offered = sites(spark, d).select(
        "org",
        F.when(F.pmod(number, F.lit(2)) == 0, F.concat(F.lit("https://"), registered_domain(F.col("final_url")), F.lit("/kontakt")))
        .otherwise(F.lit("https://annet.no/kontakt"))
        .alias("final_url"),
    )
    return disc.same_domain_pages(offered, sites(spark, d)).select("org", F.col("final_url").alias("page"))
