"""Jobs and dated updates on verified company sites, and the guard that removes imprecise ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import json_text, json_value, material_id
from ..functions.staging import with_stage
from ..functions.text import all_text_dates, first_text_date, parse_deadline, specific_title, squash, squash_lower, word_count
from ..functions.web import detail_page, is_http, non_root_page, same_site
from ..model import CLAIM, EVIDENCE, conform
from .site_surface import (
    CAREERS_ANCHOR_TERMS,
    CAREERS_PATH_TERMS,
    NON_ACTIVITY_SEGMENTS,
    decoded_path,
    has_phrase,
)

# Fixed values of the job and update rules.
JOB_PATHS = ("/job", "/jobs", "/career", "/careers", "/stilling", "/stillinger", "/ledige-stillinger", "/vacanc")
JOB_ACTIONS = (
    "apply now", "apply for", "application deadline", "send application", "søk nå", "søk stillingen", "send søknad",
    "søknadsfrist",
)
JOB_DETAILS = (
    "full-time", "part-time", "full time", "part time", "heltid", "deltid", "arbeidssted", "location", "position", "stilling",
)
GENERIC_JOB_TITLES = (
    "jobs", "job", "careers", "career", "vacancies", "vacancy", "ledige stillinger", "ledige stillinger hos oss", "karriere",
    "karriere hos oss", "jobb hos oss", "jobb",
)
JOB_SEGMENTS = (
    "job", "jobs", "career", "careers", "jobb", "jobber", "stilling", "stillinger", "ledige-stillinger", "vacancy", "vacancies",
)
JOB_QUERY_KEYS = ("job", "jobid", "job_id", "position", "positionid", "vacancy", "opening", "gh_jid")
UPDATE_PATHS = ("/news", "/nyheter", "/aktuelt", "/blog", "/press", "/presse")
UPDATE_SECTIONS = ("news", "nyheter", "aktuelt", "blog", "press", "presse")
PLACEHOLDER_TITLES = ("hello world", "hei verden", "sample page", "sample post")
PLACEHOLDER_MARKERS = ("welcome to wordpress", "this is your first post", "edit or delete it, then start writing")
DATE_METHOD_RANK = {
    "jsonld_newsarticle_date_published": 0,
    "jsonld_article_date_published": 0,
    "meta_article_published_time": 0,
    "meta_itemprop_date_published": 1,
    "meta_name_pubdate": 2,
    "meta_name_date": 2,
    "time_datetime": 3,
    "time_text": 4,
    "date_labelled_element": 4,
}
NAME_NOISE = ("as", "asa", "sa", "nuf", "gfs", "ba", "ans", "da", "enk", "konsern")
GENERIC_ROLE_TITLES = (
    "jobb", "jobber", "jobs", "karriere", "career", "careers", "ledige stillinger", "stillinger", "vacancies", "vacancy",
)
JOB_FIELD, UPDATE_FIELD, CAREERS_FIELD = "external.job_posting", "external.company_update", "external.careers_page"


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def iso_day(value: Column) -> Column:
    """Date of a full ISO day text; anything else is null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def retrieval_day(value: Column) -> Column:
    return value.try_cast("timestamp").cast("date")


# --- W12: publication date --------------------------------------------------------------------------

def publication_dates(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(org, url, date, method, raw) per page: strongest method that names exactly one day, else a lone text date.

    ``pages`` holds org, url and text; ``candidates`` holds org, url, method and raw from the page's own markup. Two
    different days of the same strength make the page abstain.
    """
    rank = F.lit(None).cast("int")
    for method, position in DATE_METHOD_RANK.items():
        rank = F.when(F.col("method") == method, F.lit(position)).otherwise(rank)
    ranked = candidates.select(
        "org", "url", "method", squash(F.col("raw")).alias("raw"), rank.alias("rank"), first_text_date(squash(F.col("raw"))).alias("date")
    ).filter(F.col("rank").isNotNull() & F.col("date").isNotNull())
    best = ranked.groupBy("org", "url").agg(F.min("rank").alias("rank"))
    strongest = ranked.join(best, ["org", "url", "rank"]).groupBy("org", "url").agg(
        F.countDistinct("date").alias("_days"), F.min_by(F.struct("date", "method", "raw"), F.struct("method", "raw")).alias("_pick")
    )
    rows = pages.select("org", "url", all_text_dates(F.col("text")).alias("_dates")).join(strongest, ["org", "url"], "left")
    lone = F.when(F.size("_dates") == 1, F.element_at("_dates", 1))
    from_text = F.struct(lone.alias("date"), F.lit("unambiguous_page_text").alias("method"), lone.alias("raw"))
    choice = F.when(F.col("_days") == 1, F.col("_pick")).when(F.col("_days").isNull() & lone.isNotNull(), from_text)
    return rows.select("org", "url", choice.alias("c")).filter(F.col("c").isNotNull()).select("org", "url", "c.*")


# --- P12: strict jobs and updates -----------------------------------------------------------------------

def _page_text() -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(name), F.lit("")) for name in ("title", "main_text", "identity_text")])


def _same_site_pages(pages: DataFrame, verified: DataFrame) -> DataFrame:
    """Pages of publishable sites on the verified site, with the day of the verified snapshot."""
    sites = verified.select("org", F.col("final_url").alias("_site"), F.col("retrieved_at").alias("_seen"))
    rows = pages.join(sites, "org").filter(is_http(F.col("url")) & same_site(F.col("url"), F.col("_site")))
    return rows.withColumn("text", _page_text()).withColumn("observed_on", retrieval_day(F.col("_seen")))


def strict_job_pages(pages: DataFrame, verified: DataFrame) -> DataFrame:
    """Role pages with a job path, a detail address, an apply action, a job detail and a specific title."""
    rows = _same_site_pages(pages, verified)
    low_url, low_text = squash_lower(F.col("url")), squash_lower(F.col("text"))
    keep = (
        _any(low_url, JOB_PATHS)
        & detail_page(F.col("url"), JOB_SEGMENTS, JOB_QUERY_KEYS)
        & _any(low_text, JOB_ACTIONS)
        & _any(low_text, JOB_DETAILS)
        & specific_title(F.col("title"), GENERIC_JOB_TITLES)
    )
    once = rows.filter(keep).dropDuplicates(["org", "url"])
    return once.select(
        "org", F.trim("title").alias("title"), "url", "content_sha256", F.col("_seen").alias("retrieved_at"),
        F.concat(F.trim("title"), F.lit("; the role page has an apply action")).alias(
            "evidence_span"
        ),
    )


def strict_updates(pages: DataFrame, verified: DataFrame, date_candidates: DataFrame) -> DataFrame:
    """Dated article pages below a news section (or nominated by the home page), never placeholders or future dates.

    ``pages`` also holds the flag ``nominated``.
    """
    rows = _same_site_pages(pages, verified)
    nominated = F.coalesce("nominated", F.lit(False))
    section = _any(squash_lower(F.col("url")), UPDATE_PATHS) | nominated
    detail = detail_page(F.col("url"), UPDATE_SECTIONS) | (nominated & non_root_page(F.col("url"), UPDATE_SECTIONS))
    bare_title = F.regexp_replace(squash_lower(F.col("title")), r"^[ !?.]+|[ !?.]+$", "")
    low = squash_lower(F.col("text"))
    markers = sum((F.contains(low, F.lit(marker)).cast("int") for marker in PLACEHOLDER_MARKERS), F.lit(0))
    placeholder = bare_title.isin(*PLACEHOLDER_TITLES) | (markers >= 2)
    kept = rows.filter(section & detail & specific_title(F.col("title"), UPDATE_SECTIONS) & ~placeholder).dropDuplicates(["org", "url"])
    dated = kept.join(publication_dates(kept, date_candidates), ["org", "url"])
    ok = dated.filter(iso_day(F.col("date")) <= F.col("observed_on"))
    return ok.select(
        "org", F.trim("title").alias("title"), "url", F.col("date").alias("published_date"), F.col("method").alias("date_method"),
        F.col("raw").alias("date_evidence"), "content_sha256", F.col("_seen").alias("retrieved_at"),
        F.concat(
            F.trim("title"), F.lit("; published date "), F.col("date"), F.lit("; date evidence "), F.col("method"), F.lit(": "), F.col("raw")
        ).alias("evidence_span"),
    )


# --- P11, J14: current jobs ----------------------------------------------------------------------------------

def employer_tokens(name: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9æøå]+)"), F.lit(1))
    return F.filter(words, lambda word: ~word.isin(*NAME_NOISE) & (F.length(word) > 1))


def employer_matches(target: Column, explicit: Column, context: Column) -> Column:
    """All tokens of the target occur in the named employer, or in the card text when no employer is named."""
    named = F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", explicit).otherwise(context)
    wanted = employer_tokens(target)
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, employer_tokens(named))) == 0)


def role_title_ok(title: Column) -> Column:
    bare = F.regexp_replace(squash_lower(title), r"^[ \-|:]+|[ \-|:]+$", "")
    words = word_count(title)
    lone = F.regexp_replace(squash(title), "^-+|-+$", "")
    return (bare != "") & ~bare.isin(*GENERIC_ROLE_TITLES) & ((words >= 2) | ((words == 1) & (F.length(lone) >= 5)))


def current_jobs(cards: DataFrame, entities: DataFrame) -> DataFrame:
    """Roles with a deadline on or after the day of observation whose employer is the company itself.

    ``cards`` holds org, source_order (home page 0, careers page 1), source_url, content_sha256, retrieved_at, title,
    role_url, application_url, deadline_raw, employer_context and hiring_organisation. The first source of an address wins.
    """
    named = cards.join(entities.select("org", "name"), "org")
    address = F.coalesce(F.nullif(F.trim("role_url"), F.lit("")), F.trim("application_url"))
    rows = named.select(
        "org", "source_order", "source_url", "content_sha256", "retrieved_at", squash(F.col("title")).alias("title"),
        address.alias("url"), F.coalesce(F.nullif(F.trim("application_url"), F.lit("")), address).alias("application_url"),
        parse_deadline(F.col("deadline_raw")).alias("deadline"), retrieval_day(F.col("retrieved_at")).alias("_seen"),
        employer_matches(F.col("name"), F.col("hiring_organisation"), F.col("employer_context")).alias("_own"),
    ).filter(
        role_title_ok(F.col("title")) & is_http(F.col("url")) & (F.col("deadline") >= F.col("_seen")) & F.col("_own")
    )
    rest = [name for name in rows.columns if name not in ("org", "url", "_seen", "_own")]
    first = rows.groupBy("org", "url").agg(F.min_by(F.struct(*rest), F.struct("source_order", "title")).alias("_row"))
    return first.select("org", "url", "_row.*").withColumn(
        "evidence_span",
        F.concat(
            F.col("title"), F.lit("; own position, open until "),
            F.col("deadline").cast("string"), F.lit("; apply at "), F.col("application_url"),
        ),
    )


def activity_claims(jobs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of jobs (org, title, url, deadline, application_url, ...) and updates (org, title, url, published_date, ...)."""

    def with_id(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn(
            "id", material_id("ev-first-party-", 20, F.col("org"), F.lit(kind), F.col("url"), F.col("content_sha256"), F.col("title"))
        )

    def pair(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), json_value(value))

    def claims_of(rows: DataFrame, field: str, value: Column, order: Column, signal: str) -> DataFrame:
        return conform(
            rows.select(
                "org", order.alias("claim_order"), F.lit(field).alias("field"), value.alias("value"),
                F.lit("available").alias("availability"), F.lit(0.99).alias("confidence"), F.array("id").alias("evidence_ids"),
                F.lit("company_site").alias("platform"), F.lit(signal).alias("signal_type"),
            ),
            CLAIM,
        )

    def evidence_of(rows: DataFrame, source: Column, effective: Column) -> DataFrame:
        return conform(
            rows.select(
                "org", "id", source.alias("source_url"), F.lit("company_owned").alias("source_class"), "retrieved_at",
                "content_sha256", F.col("evidence_span").alias("claim_span"), effective.alias("effective_at"),
            ),
            EVIDENCE,
        )

    job_rows = with_id(conform_columns(jobs, ("deadline", "application_url", "source_url")), "job")
    update_rows = with_id(updates, "update")
    job_value = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",", pair("application_url", F.col("application_url")), pair("deadline", F.col("deadline").cast("string")),
            pair("title", F.col("title")), pair("url", F.col("url")),
        ),
        F.lit("}"),
    )
    update_value = F.concat(
        F.lit("{"),
        F.concat_ws(",", pair("published_date", F.col("published_date")), pair("title", F.col("title")), pair("url", F.col("url"))),
        F.lit("}"),
    )
    # Newest updates first: dates sort by their complement to 9999-12-31.
    newest = F.lpad((F.lit(9_999_999) - F.datediff(iso_day(F.col("published_date")), F.lit("1970-01-01").cast("date"))).cast("string"), 7, "0")
    claims = claims_of(
        job_rows, JOB_FIELD, job_value, F.concat_ws("|", F.lit("90"), F.lower("title"), "url"), "job_posting"
    ).unionByName(
        claims_of(update_rows, UPDATE_FIELD, update_value, F.concat_ws("|", F.lit("91"), newest, F.lower("title"), "url"), "company_update")
    )
    null = F.lit(None).cast("string")
    evidence = evidence_of(job_rows, F.coalesce("source_url", "url"), null).unionByName(
        evidence_of(update_rows, F.col("url"), F.col("published_date"))
    )
    return claims, evidence


def conform_columns(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows with the named text columns, null where they are missing."""
    for name in names:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows


# --- P13: feed-backed updates ------------------------------------------------------------------------------------

def feed_update_claims(entries: DataFrame, claims: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of feed entries that no update claim already states (same address, day and title)."""
    sites = verified.select("org", F.col("final_url").alias("_site"), "identity_proof")
    rows = entries.join(sites, "org").filter(
        (F.regexp_replace("verified_url", "/+$", "") == F.regexp_replace("_site", "/+$", ""))
        & same_site(F.col("feed_url"), F.col("_site"))
        & is_http(F.col("url"))
        & same_site(F.col("url"), F.col("_site"))
        & (F.trim("title") != "")
        & F.coalesce("content_sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$")
        & (iso_day(F.col("published_date")) <= retrieval_day(F.col("retrieved_at")))
    )
    stated = claims.filter(F.col("field") == UPDATE_FIELD).select(
        "org", F.get_json_object("value", "$.url").alias("url"), F.get_json_object("value", "$.published_date").alias("published_date"),
        F.get_json_object("value", "$.title").alias("title"),
    )
    new = rows.join(stated, ["org", "url", "published_date", "title"], "left_anti").dropDuplicates(
        ["org", "url", "published_date", "title"]
    ).withColumn(
        "id",
        material_id(
            "ev-first-party-feed-", 20, F.col("org"), F.col("feed_url"), F.col("content_sha256"), F.col("url"), F.col("published_date"),
            F.col("title"),
        ),
    )
    value = F.concat(
        F.lit('{"published_date":'), json_value(F.col("published_date")), F.lit(',"title":'), json_value(F.col("title")),
        F.lit(',"url":'), json_value(F.col("url")), F.lit("}"),
    )
    new_claims = new.select(
        "org", F.concat_ws("|", F.lit("95"), F.lpad(F.col("position").cast("string"), 6, "0"), "url").alias("claim_order"),
        F.lit(UPDATE_FIELD).alias("field"), value.alias("value"), F.lit("available").alias("availability"),
        F.lit(0.99).alias("confidence"), F.array("id").alias("evidence_ids"), F.lit("company_site").alias("platform"),
        F.lit("company_update").alias("signal_type"),
    )
    evidence = new.select(
        "org", "id", F.col("feed_url").alias("source_url"), F.lit("company_owned").alias("source_class"), "retrieved_at",
        "content_sha256", F.col("evidence_span").alias("claim_span"), F.col("published_date").alias("effective_at"),
        "identity_proof", F.lit("verified_same_site_rss_atom_entry_v1").alias("extraction_method"),
    )
    return conform(new_claims, CLAIM), conform(evidence, EVIDENCE)


# --- F10: precision guard -------------------------------------------------------------------------------------------

def precision_guard(claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop careers and update claims that fail the wording, path, placeholder or date rules, and their own evidence.

    Kept claims and evidence are never changed; evidence that was referenced by nobody stays.
    """
    # Each value is read once; rule ladders would otherwise copy its parsing into every branch.
    judged_field = F.col("field").isin(CAREERS_FIELD, UPDATE_FIELD)
    rows = with_stage(claims, "_url", F.when(judged_field, F.coalesce(F.trim(F.get_json_object("value", "$.url")), F.lit(""))))
    rows = with_stage(rows, "_path", F.when(judged_field, decoded_path(F.col("_url"))))
    url = F.col("_url")
    segments = F.filter(F.transform(F.split("_path", "/"), lambda item: F.trim(item)), lambda part: part != "")
    outside = F.exists(segments, lambda part: part.isin(*NON_ACTIVITY_SEGMENTS))
    anchor = F.get_json_object("value", "$.anchor_text")
    marked = has_phrase(F.regexp_replace("_path", r"[-_/]+", " "), CAREERS_PATH_TERMS) | has_phrase(anchor, CAREERS_ANCHOR_TERMS)
    careers_ok = is_http(url) & ~outside & marked

    # The newest retrieval day of all evidence of a claim; one unusable reference makes the claim unusable.
    updates = claims.filter(F.col("field") == UPDATE_FIELD)
    refs = updates.select("org", "claim_order", F.explode("evidence_ids").alias("id"))
    seen = refs.join(evidence.select("org", "id", retrieval_day(F.col("retrieved_at")).alias("_day")), ["org", "id"], "left")
    days = seen.groupBy("org", "claim_order").agg(F.max("_day").alias("_latest"), F.bool_and(F.col("_day").isNotNull()).alias("_complete"))
    title = F.regexp_replace(squash_lower(F.get_json_object("value", "$.title")), r"^[ .!?:;\-]+|[ .!?:;\-]+$", "")
    update_ok = is_http(url) & (title != "") & ~title.isin(*PLACEHOLDER_TITLES) & ~outside
    own = F.when(F.col("field") == CAREERS_FIELD, careers_ok).when(F.col("field") == UPDATE_FIELD, update_ok).otherwise(F.lit(True))
    rows = with_stage(rows, "_own", F.coalesce(own, F.lit(False)))
    rows = with_stage(rows, "_published", F.when((F.col("field") == UPDATE_FIELD) & F.col("_own"), F.trim(F.get_json_object("value", "$.published_date"))))
    rows = rows.select(*claims.columns, "_own", iso_day(F.col("_published")).alias("_published")).join(days, ["org", "claim_order"], "left")
    in_time = (F.col("field") != UPDATE_FIELD) | (F.col("_complete") & (F.col("_published") <= F.col("_latest")))
    judged = rows.withColumn("_keep", F.col("_own") & F.coalesce(in_time, F.col("field").isNull()))
    kept = judged.filter("_keep").select(*claims.columns)
    # Evidence of dropped claims that no kept claim points to, in one pass over all references.
    refs = judged.select("org", F.explode("evidence_ids").alias("id"), "_keep")
    orphaned = refs.groupBy("org", "id").agg(F.bool_or("_keep").alias("_held")).filter(~F.col("_held"))
    return kept, evidence.join(orphaned, ["org", "id"], "left_anti").select(*evidence.columns)


# --- J18: provenance of older activity rows ------------------------------------------------------------------------

LEGACY_METHODS = {
    UPDATE_FIELD: ("company_update", "verified_same_site_dated_detail_page_v1"),
    JOB_FIELD: ("job_posting", "verified_same_site_job_detail_page_v1"),
}


def activity_provenance(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Fill identity proof and method of page-backed activity evidence from the verified website's own evidence."""
    sites = claims.filter(
        (F.col("field") == "official_website") & (F.col("availability") == "available")
    ).select("org", F.trim(json_text(F.col("value"))).alias("site"), F.col("claim_order").alias("_order"), F.explode("evidence_ids").alias("id"))
    proofs = (
        sites.filter(is_http(F.col("site")))
        .join(evidence.select("org", "id", "source_url", "identity_proof"), ["org", "id"])
        .filter(same_site(F.col("source_url"), F.col("site")) & (F.coalesce("identity_proof", F.lit("")) != ""))
    )
    site = proofs.groupBy("org").agg(F.min_by(F.struct("site", "identity_proof"), F.struct("_order", "id")).alias("s"))
    signal, method = F.lit(None).cast("string"), F.lit(None).cast("string")
    for field, (name, text) in LEGACY_METHODS.items():
        signal = F.when(F.col("field") == field, F.lit(name)).otherwise(signal)
        method = F.when(F.col("field") == field, F.lit(text)).otherwise(method)
    stated = claims.filter(
        F.col("field").isin(*LEGACY_METHODS) & (F.col("availability") == "available") & (F.col("platform") == "company_site")
        & (F.col("signal_type") == signal)
    ).select(
        "org", "claim_order", method.alias("_method"), F.trim(F.get_json_object("value", "$.url")).alias("_url"),
        F.when(F.col("field") == UPDATE_FIELD, F.coalesce(F.get_json_object("value", "$.published_date"), F.lit(""))).alias("_day"),
        F.explode("evidence_ids").alias("id"),
    )
    backing = evidence.select("org", "id", "source_url", "source_class", "content_sha256", "effective_at")
    fits = (
        is_http(F.col("_url"))
        & same_site(F.col("_url"), F.col("s.site"))
        & F.startswith(F.col("id"), F.lit("ev-first-party-"))
        & ~F.startswith(F.col("id"), F.lit("ev-first-party-feed-"))
        & (F.col("source_class") == "company_owned")
        & is_http(F.col("source_url"))
        & same_site(F.col("source_url"), F.col("s.site"))
        & same_site(F.col("source_url"), F.col("_url"))
        & F.coalesce("content_sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$")
        & (F.col("_day").isNull() | ((F.col("_day") != "") & (F.trim(F.coalesce("effective_at", F.lit(""))) == F.col("_day"))))
    )
    matched = stated.join(backing, ["org", "id"]).join(site, "org").filter(fits)
    fill = matched.groupBy("org", "id").agg(
        F.min_by(F.struct("s.identity_proof", "_method"), F.col("claim_order")).alias("_fill")
    )
    rows = evidence.join(fill, ["org", "id"], "left")
    return rows.select(
        *[name for name in evidence.columns if name not in ("identity_proof", "extraction_method")],
        F.coalesce(F.nullif("identity_proof", F.lit("")), F.col("_fill.identity_proof")).alias("identity_proof"),
        F.coalesce(F.nullif("extraction_method", F.lit("")), F.col("_fill._method")).alias("extraction_method"),
    ).select(*evidence.columns)


