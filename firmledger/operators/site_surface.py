"""What a verified company site shows: link picks, contacts, handles, careers, hiring signals and crawl ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import json_value, material_id
from ..functions.staging import with_stage
from ..functions.text import squash, squash_lower, tokens, word_count
from ..functions.values import clamped_score
from ..functions.web import (
    bare_host, hosts_related, is_http, normalize_homepage, path_segments, registered_domain, resolve_link, url_host, url_path,
)
from ..model import CLAIM, EVIDENCE, OBSERVATION, conform
from ..sources.pages import CARD_DATE

# Link terms in order of interest.
PRIORITY_TERMS = (
    "om-oss", "om_oss", "about", "kontakt", "contact", "ledelse", "management", "team", "people", "locations", "lokasjoner",
    "avdelinger", "butikker", "news", "press", "aktuelt", "nyheter",
)
IDENTITY_TERMS = (
    "personvern", "privacy-policy", "privacy", "legal", "impressum", "vilkar", "terms", "organisasjonsnummer", "orgnr",
    "org-nr", "selskapsinfo", "company-info", "kontaktinformasjon", "kontakt", "contact", "om-oss", "om_oss", "about",
    "company", "firma",
)
CAREERS_ANCHOR_TERMS = (
    "career", "careers", "join our team", "work with us", "job opportunities", "karriere", "jobb hos oss", "jobbe hos oss",
    "ledige stillinger", "ledige-stillinger", "stillinger", "vacancies", "vacancy",
)
CAREERS_PATH_TERMS = (
    "career", "careers", "karriere", "jobb", "jobber", "stilling", "stillinger", "ledige stillinger", "vacancy", "vacancies",
)
NEWS_SECTIONS = ("aktuelt", "nyheter", "news", "blog", "blogg", "press", "presse", "artikler", "articles")
GENERIC_NEWS_ANCHORS = (*NEWS_SECTIONS, "les mer", "read more")
NON_ACTIVITY_SEGMENTS = (
    "profil", "profile", "profiles", "person", "persons", "user", "users", "bruker", "brukere", "bolig", "boliger", "property",
    "properties", "listing", "listings", "annonse", "annonser",
)
DATE_HINT = r"\b(?:20\d{2}-[01]\d-[0-3]\d|[0-3]?\d[./-][01]?\d[./-](?:20\d{2}|\d{2}))\b"
BLOCKED_LOCAL_PARTS = (
    "example", "name", "yourname", "email", "test", "noreply", "no-reply", "donotreply", "do-not-reply",
)
EMAIL_PATTERN = r"(?i)(?<![A-Z0-9._%+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?![A-Z0-9._%+-])"
# Wording of an explicit vacancy count.
VACANCY_PATTERNS = (
    r"(?i)\b(\d+)\s+(?:antall\s+)?ledige\s+stillinger\b",
    r"(?i)\bantall\s+ledige\s+stillinger(?:\s+[^\d\s]+){0,6}\s+(\d+)\b",
    r"(?i)\b(\d+)\s+(?:open\s+positions|open\s+roles|open\s+vacancies|vacancies)\b",
    r"(?i)\b(?:open\s+positions|open\s+roles|open\s+vacancies|vacancies)\s*[:\-]?\s*(\d+)\b",
)
SOCIAL_HANDLE_HOSTS = {
    "linkedin": "linkedin.com", "facebook": "facebook.com", "instagram": "instagram.com", "x": "x.com",
    "youtube": "youtube.com", "tiktok": "tiktok.com",
}
DECLARATION_STRATEGY = "verified_company_homepage_declaration_c12_v1"
HANDLE_STRATEGY = "verified_company_page_handle_extraction_v1"
RECOVERY_STRATEGY = "verified_company_homepage_social_recovery_v1"
EMAIL_STRATEGY = "verified_company_page_same_domain_email_v1"
LEGAL_SUFFIXES = ("as", "asa", "da", "sa", "enk", "ans", "ba", "nuf")


def phrase_rank(text: Column, terms: tuple[str, ...]) -> Column:
    """Position of the first term that stands in the text as whole words; null when none does."""
    body = squash_lower(text)
    rank = F.lit(None).cast("int")
    for index in reversed(range(len(terms))):
        pattern = r"(?<![\p{L}\p{N}_])\Q" + terms[index] + r"\E(?![\p{L}\p{N}_])"
        rank = F.when(body.rlike(pattern), F.lit(index)).otherwise(rank)
    return rank


def has_phrase(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the terms stands in the text as whole words; the text is folded and read once. False for null."""
    either = "|".join(r"\Q" + term + r"\E" for term in terms)
    return squash_lower(text).rlike(r"(?<![\p{L}\p{N}_])(?:" + either + r")(?![\p{L}\p{N}_])")


def term_rank(text: Column, terms: tuple[str, ...]) -> Column:
    """Position of the first term contained in the text; null when none is."""
    rank = F.lit(None).cast("int")
    for index in reversed(range(len(terms))):
        rank = F.when(F.contains(text, F.lit(terms[index])), F.lit(index)).otherwise(rank)
    return rank


def decoded_path(url: Column) -> Column:
    raw = url_path(url)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))


def _path_words(url: Column) -> Column:
    return F.regexp_replace(decoded_path(url), r"[-_/]+", " ")


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"/+$", "")


# --- W17: link picks -------------------------------------------------------------------------------

def _leading(rows: DataFrame, keys: list[str], order: list[Column], count: int | None) -> DataFrame:
    """All rows with their rank per key as ``pick``; with a count only the first ones, cut inside every map task."""
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if count is None else ranked.filter(F.col("pick") <= count)


def _once(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def priority_links(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Same-host links that speak of contact, people or news: best term, then address."""
    text = F.lower(F.concat(url_path(F.col("url")), F.lit(" "), F.coalesce("anchor_text", F.lit(""))))
    rows = links.filter(is_http(F.col("url")) & (url_host(F.col("url")) == url_host(F.col("final_url")))).select(
        "org", "final_url", F.col("clean_url").alias("url"), term_rank(text, PRIORITY_TERMS).alias("rank")
    )
    rows = rows.filter(F.col("rank").isNotNull() & (_trimmed(F.col("url")) != _trimmed(F.col("final_url"))))
    best = rows.groupBy("org", "final_url", "url").agg(F.min("rank").alias("rank"))
    return _leading(best, ["org", "final_url"], [F.col("rank"), F.col("url")], limit)


def identity_links(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Links of the same registered domain to legal and contact pages: best term, shorter path, address."""
    text = F.concat(decoded_path(F.col("url")), F.lit(" "), F.lower(F.coalesce("anchor_text", F.lit(""))))
    home = registered_domain(F.col("final_url"))
    rows = links.filter(is_http(F.col("url")) & (home != "") & (registered_domain(F.col("url")) == home)).select(
        "org", "final_url", F.col("clean_url").alias("url"), "position", term_rank(text, IDENTITY_TERMS).alias("rank")
    )
    rows = rows.filter(F.col("rank").isNotNull() & (_trimmed(F.col("url")) != _trimmed(F.col("final_url"))))
    first = _once(rows, ["org", "final_url", "url"], F.col("position"))
    return _leading(first, ["org", "final_url"], [F.col("rank"), F.length(url_path(F.col("url"))), F.col("url")], limit)


def careers_links(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Links of the same company host to a careers page, by path words or by anchor text."""
    path_rank = phrase_rank(_path_words(F.col("url")), CAREERS_PATH_TERMS)
    anchor = squash(F.col("anchor_text"))
    anchor_rank = F.when(anchor != "", phrase_rank(anchor, CAREERS_ANCHOR_TERMS))
    path_terms, anchor_terms = (
        F.array(*[F.lit(term) for term in terms]) for terms in (CAREERS_PATH_TERMS, CAREERS_ANCHOR_TERMS)
    )
    marker = F.coalesce(
        F.try_element_at(path_terms, path_rank + 1), F.try_element_at(anchor_terms, anchor_rank + 1)
    )
    same = hosts_related(bare_host(F.col("url")), bare_host(F.col("final_url")))
    address = F.regexp_replace(F.col("url"), r"#.*$", "")
    rows = links.filter(is_http(F.col("url")) & same).select(
        "org", "final_url", "content_sha256", "retrieved_at", "position", address.alias("url"), anchor.alias("anchor_text"),
        marker.alias("marker"),
    )
    first = _once(rows.filter(F.col("marker").isNotNull()), ["org", "final_url", "url"], F.col("position"))
    picked = _leading(first, ["org", "final_url"], [F.length(url_path(F.col("url"))), F.col("url")], limit)
    label = F.when(F.col("anchor_text") != "", F.col("anchor_text")).otherwise(F.col("url"))
    return picked.withColumn("evidence_span", F.concat(F.lit("Homepage link: "), label))


def careers_surface_order(url: Column, marker: Column) -> Column:
    """Which careers link is followed first: open positions, then job lists, then the rest; shorter paths first."""
    text = F.concat(decoded_path(url), F.lit(" "), F.lower(F.coalesce(marker, F.lit(""))))
    rank = (
        F.when(text.rlike("ledige[- ]stillinger"), 0)
        .when(text.rlike("/jobs|/jobber|vacanc|stillinger"), 1)
        .otherwise(2)
    )
    return F.struct(rank, F.length(url_path(url)), url)


def news_links(links: DataFrame, limit: int | None = None) -> DataFrame:
    """Links to single news items in document order: below a news section, or in a dated card."""
    sections = path_segments(F.col("clean_url"))
    marked = F.transform(
        sections, lambda part, index: F.when(part.isin(*NEWS_SECTIONS), index).otherwise(F.lit(-1))
    )
    last = F.array_max(marked)
    specific = F.coalesce((last >= 0) & (last < F.size(sections) - 1), F.lit(False))
    section = F.when(F.coalesce(last, F.lit(-1)) >= 0, F.try_element_at(sections, (last + 1).cast("int")))
    anchor = squash(F.col("anchor_text"))
    dated = F.when(anchor.rlike(DATE_HINT), anchor).when(
        F.coalesce("card_text", F.lit("")).rlike(DATE_HINT), F.col("card_text")
    )
    home = registered_domain(F.col("final_url"))
    outside = F.exists(sections, lambda part: part.isin(*NON_ACTIVITY_SEGMENTS))
    generic = F.regexp_replace(F.lower(anchor), r"^[ \-|:]+|[ \-|:]+$", "").isin(*GENERIC_NEWS_ANCHORS)
    keep = (
        is_http(F.col("url")) & (home != "") & (registered_domain(F.col("clean_url")) == home)
        & (_trimmed(F.col("clean_url")) != _trimmed(F.col("final_url")))
        & (specific | dated.isNotNull())
        & (specific | ~outside)
        & (~generic | dated.isNotNull())
    )
    rows = links.filter(keep).select(
        "org", "final_url", F.col("clean_url").alias("url"), "position", anchor.alias("anchor_text"),
        F.coalesce(section, F.lit("dated_homepage_card")).alias("marker"), dated.alias("dated_context"),
    )
    first = _once(rows, ["org", "final_url", "url"], F.col("position"))
    return _leading(first, ["org", "final_url"], [F.col("position")], limit)


# --- P9: careers claims ---------------------------------------------------------------------------------

def careers_claims(picked: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Careers-page claims of verified home pages; the link must stem from the very snapshot that was verified.

    ``verified`` holds org, final_url, content_sha256, retrieved_at and score of publishable sites.
    """
    sites = verified.filter(is_http(F.col("final_url")) & (F.length(F.coalesce("content_sha256", F.lit(""))) == 64)).select(
        "org", "final_url", "content_sha256", "score", F.col("retrieved_at").alias("_retrieved_at")
    )
    rows = picked.filter(is_http(F.col("url"))).join(sites, ["org", "final_url", "content_sha256"])
    rows = _once(rows, ["org", "url"], F.col("pick")).withColumn(
        "id", material_id("ev-careers-", 20, F.col("org"), F.col("url"), F.col("content_sha256"))
    )
    value = F.concat(
        F.lit('{"anchor_text":'), F.coalesce(json_value(F.nullif("anchor_text", F.lit(""))), F.lit("null")), F.lit(',"url":'),
        json_value(F.col("url")), F.lit("}"),
    )
    claims = rows.select(
        "org", F.concat(F.lit("80|"), F.lpad(F.col("pick").cast("string"), 6, "0")).alias("claim_order"),
        F.lit("external.careers_page").alias("field"), value.alias("value"), F.lit("available").alias("availability"),
        clamped_score(F.col("score"), 0.95).alias("confidence"), F.array("id").alias("evidence_ids"),
        F.lit("company_site").alias("platform"), F.lit("careers_page").alias("signal_type"),
        F.lit("Link to a careers page; says nothing about open positions.").alias("claim_scope"),
    )
    evidence = rows.select(
        "org", "id", F.col("final_url").alias("source_url"), F.lit("company_owned").alias("source_class"),
        F.col("_retrieved_at").alias("retrieved_at"), "content_sha256", F.col("evidence_span").alias("claim_span"),
    )
    return conform(claims, CLAIM), conform(evidence, EVIDENCE)


# --- W18: contact addresses --------------------------------------------------------------------------------

def contact_emails(text: Column, site_url: Column) -> Column:
    """All addresses of the site's own registered domain in a text, sorted."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL_PATTERN), F.lit(1)), F.lower)
    domain = registered_domain(site_url)
    own = F.filter(
        found,
        lambda email: (F.size(F.split(email, "@")) == 2)
        & ~F.element_at(F.split(email, "@"), 1).isin(*BLOCKED_LOCAL_PARTS)
        & (domain != "")
        & (registered_domain(F.concat(F.lit("https://"), F.element_at(F.split(email, "@"), 2))) == domain),
    )
    return F.array_sort(F.array_distinct(own))


def contact_observations(verified: DataFrame) -> DataFrame:
    """Contact-address observations of publishable sites with identity text."""
    rows = verified.filter(
        F.col("org").rlike("^[0-9]{9}$") & is_http(F.col("final_url")) & (F.length(F.coalesce("content_sha256", F.lit(""))) == 64)
        & (F.coalesce("retrieved_at", F.lit("")) != "")
    ).withColumn("contact_email", F.explode(contact_emails(F.col("identity_text"), F.col("final_url"))))
    proof = F.array(
        F.create_map(F.lit("type"), F.lit("website_identity_gate"), F.lit("score"), F.col("score").cast("string")),
        F.create_map(F.lit("type"), F.lit("same_registered_domain_contact_email"), F.lit("registered_domain"), registered_domain(F.col("final_url"))),
    )
    observations = rows.select(
        material_id("company-site-email-", 24, F.col("org"), F.col("contact_email"), F.col("final_url"), F.col("content_sha256")).alias("id"),
        "org", F.lit("company_site").alias("platform"), F.lit("company_profile").alias("signal_type"),
        F.col("final_url").alias("source_url"), "retrieved_at", "content_sha256", F.lit(True).alias("exact_entity"),
        proof.alias("identity_proof"), F.lit("permitted_public_page").alias("acquisition_mode"),
        F.lit("approved").alias("rights_status"), F.lit("company_site").alias("source_class"),
        F.concat(F.lit("Verified company page publishes contact email "), F.col("contact_email")).alias("evidence_span"),
        "contact_email", F.create_map(F.lit("identity_score"), F.col("score").cast("string")).alias("metrics"),
        F.lit(EMAIL_STRATEGY).alias("strategy"),
    )
    return conform(observations, OBSERVATION)


# --- P7, J13: declared handles ---------------------------------------------------------------------------------

def safe_profile_url(platform: Column, url: Column) -> Column:
    """Address that has the shape of a company profile on its platform."""
    expected = F.lit(None).cast("string")
    for name, host in SOCIAL_HANDLE_HOSTS.items():
        expected = F.when(platform == name, F.lit(host)).otherwise(expected)
    raw = F.coalesce(F.try_url_decode(url_path(url)), url_path(url))
    parts = F.filter(F.transform(F.split(raw, "/"), lambda item: F.trim(item)), lambda part: part != "")
    count = F.size(parts)
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    low = F.lower(first)
    handle = F.startswith(first, F.lit("@"))
    nested = F.exists(
        parts,
        lambda part: F.lower(part).rlike(r"^(?:https?:|www\.)|" + "|".join(host.replace(".", r"\.") for host in SOCIAL_HANDLE_HOSTS.values())),
    )
    shape = (
        F.when(platform == "linkedin", (count == 2) & (low == "company"))
        .when(platform.isin("instagram", "x"), count == 1)
        .when(platform == "tiktok", (count == 1) & handle)
        .when(platform == "youtube", ((count == 1) & handle) | ((count == 2) & low.isin("channel", "user", "c")))
        .when(platform == "facebook", (count == 1) | ((count == 2) & (low == "p")))
        .otherwise(F.lit(False))
    )
    return F.coalesce(is_http(url) & (bare_host(url) == expected) & (count > 0) & ~nested & shape, F.lit(False))


def readable_handle(platform: Column, parts: Column) -> Column:
    """The readable name in the path parts of a profile address; null for opaque numbers and channel ids."""
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    second = F.try_element_at(parts, F.lit(2))
    bare = F.regexp_replace(first, "^@+", "")
    return (
        F.when(platform == "linkedin", second)
        .when(platform.isin("instagram", "x", "tiktok"), bare)
        .when((platform == "facebook") & (F.size(parts) == 1), F.when(~first.rlike("^[0-9]+$"), first))
        .when((platform == "facebook") & (F.lower(first) == "p"), second)
        .when((platform == "youtube") & F.startswith(first, F.lit("@")), bare)
        .when((platform == "youtube") & F.lower(first).isin("user", "c"), second)
    )


def with_declaration_verdict(rows: DataFrame) -> DataFrame:
    """Add ``declared_ok``: a handle must fit the site or the legal name, unless its address holds no readable name.

    ``rows`` holds _name, final_url, platform, url and publishable (the verdict of the handle rules).
    """
    decoded = F.coalesce(F.try_url_decode(url_path(F.col("url"))), url_path(F.col("url")))
    rows = rows.withColumn("_parts", F.filter(F.split(decoded, "/"), lambda part: F.trim(part) != ""))
    rows = rows.withColumn("_handle", readable_handle(F.col("platform"), F.col("_parts")))
    rows = rows.withColumn("_compact", F.array_join(tokens(F.col("_handle")), "")).withColumn(
        "_brand", F.array_join(tokens(F.element_at(F.split(bare_host(F.col("final_url")), r"\."), 1)), "")
    )
    compact, brand = F.col("_compact"), F.col("_brand")
    words = F.filter(tokens(F.col("_name")), lambda word: ~word.isin(*LEGAL_SUFFIXES) & (F.length(word) >= 4))
    rows = rows.withColumn("_hits", F.filter(words, lambda word: F.contains(compact, word) | F.contains(word, compact)))
    site_fits = (F.length(brand) >= 4) & (F.contains(brand, compact) | F.contains(compact, brand))
    name_fits = (F.size("_hits") >= 2) | ((F.size("_hits") == 1) & (F.length(F.try_element_at("_hits", F.lit(1))) >= 6))
    readable = (F.length(compact) >= 4) & (site_fits | F.coalesce(name_fits, F.lit(False)))
    verdict = F.coalesce("publishable", F.lit(False)) | F.col("_handle").isNull() | F.coalesce(readable, F.lit(False))
    return with_stage(rows, "declared_ok", verdict).drop("_parts", "_handle", "_compact", "_brand", "_hits")


def handle_observations(handles: DataFrame, entities: DataFrame, verified: DataFrame) -> DataFrame:
    """Handle observations of verified home pages; the first strategy that supports a profile wins.

    ``handles`` are assessed links (org, final_url, content_sha256, origin, platform, url, publishable, identity_score,
    single_page). Direct declarations need a single-page snapshot; ``sameAs`` links need a publishable handle.
    """
    sites = verified.select("org", "final_url", "content_sha256", "retrieved_at", F.col("score").alias("_site_score"))
    rows = (
        handles.drop("retrieved_at")
        .join(sites, ["org", "final_url", "content_sha256"])
        .join(entities.select("org", F.col("name").alias("_name")), "org")
        .filter(F.col("org").rlike("^[0-9]{9}$"))
    )
    rows = with_stage(rows, "_safe", safe_profile_url(F.col("platform"), F.col("url"))).filter("_safe")
    rows = with_declaration_verdict(rows)
    direct = (F.col("origin") == "link") & F.col("single_page") & F.col("declared_ok")
    gated = (F.col("origin") == "link") & F.col("single_page") & F.col("publishable")
    recovered = F.col("publishable")
    rank = F.when(direct, 0).when(gated, 1).when(recovered, 2)
    rows = with_stage(rows, "_rank", rank).filter(F.col("_rank").isNotNull())
    first = _once(rows, ["org", "platform", "url"], F.struct("_rank", "final_url", "origin"))
    strategy = F.when(F.col("_rank") == 0, DECLARATION_STRATEGY).when(F.col("_rank") == 1, HANDLE_STRATEGY).otherwise(RECOVERY_STRATEGY)
    score = F.when(F.col("_rank") == 2, F.col("identity_score")).otherwise(clamped_score(F.col("_site_score"), 0.95))
    plain = material_id(
        "company-site-handle-", 24, F.col("org"), F.col("platform"), F.col("url"), F.col("final_url"), F.col("content_sha256"), F.col("strategy")
    )
    recovery = material_id(
        "company-site-handle-v6e-", 24, F.col("org"), F.col("platform"), F.col("url"), F.col("final_url"), F.col("content_sha256")
    )
    proof = F.array(
        F.create_map(F.lit("type"), F.lit("website_identity_gate"), F.lit("score"), F.col("_site_score").cast("string")),
        F.create_map(F.lit("type"), F.lit("primary_homepage_provenance"), F.lit("content_sha256"), F.col("content_sha256")),
        F.create_map(F.lit("type"), F.lit("company_page_declared_social_link"), F.lit("profile_url"), F.col("url")),
    )
    observations = first.withColumn("strategy", strategy).select(
        F.when(F.col("_rank") == 2, recovery).otherwise(plain).alias("id"),
        "org", "platform", F.lit("profile_handle").alias("signal_type"), F.col("final_url").alias("source_url"), "retrieved_at",
        "content_sha256", F.lit(True).alias("exact_entity"), proof.alias("identity_proof"),
        F.lit("permitted_public_page").alias("acquisition_mode"), F.lit("approved").alias("rights_status"),
        F.lit("company_site").alias("source_class"),
        F.concat(F.lit("Home page names "), F.col("platform"), F.lit(" profile "), F.col("url")).alias("evidence_span"),
        F.col("url").alias("profile_url"), F.create_map(F.lit("identity_score"), score.cast("string")).alias("metrics"), "strategy",
    )
    return conform(observations, OBSERVATION)


# --- P8: handle and contact claims ----------------------------------------------------------------------------

def _observation_evidence(rows: DataFrame, subject: str) -> DataFrame:
    return rows.withColumn(
        "_evidence_id",
        material_id("ev-external-", 20, F.col("org"), F.col("id"), F.col("source_url"), F.col("content_sha256"), F.col(subject)),
    )


def _evidence_of(rows: DataFrame) -> DataFrame:
    evidence = rows.select(
        "org", F.col("_evidence_id").alias("id"), "source_url", F.lit("company_owned").alias("source_class"), "retrieved_at",
        "content_sha256", F.col("evidence_span").alias("claim_span"),
    )
    return conform(evidence, EVIDENCE)


def handle_claims(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One claim per validated handle, and the aggregate ``social_links`` claim with the lowest confidence.

    ``observations`` come from the validator; only publishable handles with an address count.
    """
    rows = _observation_evidence(
        observations.filter(F.col("publishable") & (F.col("signal_type") == "profile_handle") & is_http(F.col("profile_url"))),
        "profile_url",
    ).withColumn("_confidence", clamped_score(F.col("metrics")["identity_score"], 0.95))
    single = rows.select(
        "org", F.concat_ws("|", F.lit("82"), "platform", "profile_url", "id").alias("claim_order"),
        F.lit("external.profile_handle").alias("field"), json_value(F.col("profile_url")).alias("value"),
        F.lit("available").alias("availability"), F.col("_confidence").alias("confidence"),
        F.array("_evidence_id").alias("evidence_ids"), "platform", F.lit("profile_handle").alias("signal_type"),
        F.col("id").alias("observation_id"),
    )
    # A company has a handful of profiles: one per platform and address on its own home page.
    listed = F.array_sort(F.collect_list(F.struct("platform", F.col("profile_url").alias("url"), "id", "_evidence_id")))
    grouped = rows.groupBy("org").agg(listed.alias("_list"), F.min("_confidence").alias("confidence"))
    together = grouped.select(
        "org", F.lit("83|").alias("claim_order"), F.lit("social_links").alias("field"),
        F.to_json(F.transform("_list", lambda item: F.struct(item["platform"].alias("platform"), item["url"].alias("url")))).alias("value"),
        F.lit("available").alias("availability"), "confidence",
        F.transform("_list", lambda item: item["_evidence_id"]).alias("evidence_ids"), F.lit("profile_handle").alias("signal_type"),
    )
    return conform(single, CLAIM).unionByName(conform(together, CLAIM)), _evidence_of(rows)


def contact_claims(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One claim per validated contact address."""
    email = F.lower(F.trim(F.coalesce("contact_email", F.lit(""))))
    rows = _observation_evidence(
        observations.filter(
            F.col("publishable") & (F.col("signal_type") == "company_profile") & (F.size(F.split(email, "@")) == 2)
        ).withColumn("contact_email", email),
        "contact_email",
    )
    claims = rows.select(
        "org", F.concat_ws("|", F.lit("84"), "contact_email", "id").alias("claim_order"),
        F.lit("external.contact_email").alias("field"), json_value(F.col("contact_email")).alias("value"),
        F.lit("available").alias("availability"), clamped_score(F.col("metrics")["identity_score"], 0.95).alias("confidence"),
        F.array("_evidence_id").alias("evidence_ids"), F.lit("company_site").alias("platform"),
        F.lit("company_profile").alias("signal_type"), F.col("id").alias("observation_id"),
    )
    return conform(claims, CLAIM), _evidence_of(rows)


# --- P10: hiring signal ------------------------------------------------------------------------------------

def vacancy_count(text: Column, most: int = 500) -> Column:
    """Largest explicit vacancy count of 1 to ``most`` in a page text, else zero; larger numbers are no vacancy counts."""
    body = squash(text)
    found = F.concat(*[F.regexp_extract_all(body, F.lit(pattern), F.lit(1)) for pattern in VACANCY_PATTERNS])
    counts = F.filter(F.transform(found, lambda item: item.try_cast("int")), lambda count: count.between(1, most))
    return F.coalesce(F.array_max(counts), F.lit(0))


# Path segments of careers sections, anchors that name no role, and wording of an apply link.
CAREER_SEGMENTS = (
    "career", "careers", "karriere", "jobb", "jobber", "jobs", "stilling", "stillinger", "ledige-stillinger", "vacancy", "vacancies",
)
GENERIC_ROLE_ANCHORS = (
    "jobb", "jobber", "jobs", "karriere", "career", "careers", "ledige stillinger", "stillinger", "vacancies", "vacancy", "les mer",
    "read more", "se mer",
)
APPLY_WORDING = ("søk på stillingen", "søk stillingen", "send søknad", "søk nå", "apply now", "apply for", "apply")


def _role_title(title: Column) -> Column:
    bare = F.regexp_replace(squash_lower(title), r"^[ \-|:]+|[ \-|:]+$", "")
    words = word_count(title)
    return (bare != "") & ~bare.isin(*GENERIC_ROLE_ANCHORS) & ((words >= 2) | ((words == 1) & (F.length(bare) >= 5)))


def _plain_letters(words: Column) -> Column:
    """Words in lower case with the three Norwegian letters spelled out."""
    return F.transform(words, lambda word: F.translate(F.replace(F.lower(word), F.lit("æ"), F.lit("ae")), "øå", "oa"))


def title_before_details(title: Column, url: Column) -> Column:
    """The leading words of a role anchor that its address spells out; the anchor as it is where it does not.

    Anchors around whole cards go on with place, employer and deadline. An address of more than eight words, or a bare number, names no title.
    """
    last = F.coalesce(F.try_element_at(path_segments(url), F.lit(-1)), F.lit(""))
    last = F.lower(F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last))
    named = F.filter(F.split(last, "[-_]+"), lambda word: word != "")
    anchor = F.regexp_extract_all(title, F.lit(r"(?U)([\w-]+)"), F.lit(1))
    count = F.size(named)
    lead = F.slice(anchor, F.lit(1), F.greatest(count, F.lit(0)))
    spelled = count.between(1, 8) & ~last.rlike("^[0-9]+$") & (F.size(anchor) >= count) & (_plain_letters(lead) == _plain_letters(named))
    short = F.array_join(lead, " ")
    return F.when(spelled & _role_title(short), short).otherwise(title)


_PAGE = ("org", "final_url", "content_sha256", "retrieved_at")


def role_cards(links: DataFrame, events: DataFrame) -> DataFrame:
    """Role links with the smallest dated element around them that holds no other role link, as ranges over the page.

    An element holds the links ``first_link`` to ``end_link``, so the number of role links in it is the difference of two running
    counts, and the apply link of a card is the next one from its first link on. Nothing is compared in pairs: every element
    looks up its two ends.
    """
    segments = path_segments(F.col("url"))
    marked = F.transform(segments, lambda part, index: F.when(part.isin(*CAREER_SEGMENTS), index).otherwise(F.lit(-1)))
    last = F.array_max(marked)
    below = F.coalesce((last >= 0) & (last < F.size(segments) - 1), F.lit(False))
    own = hosts_related(bare_host(F.col("url")), bare_host(F.col("final_url")))
    anchor = squash(F.col("anchor_text"))
    applying = F.lit(False)
    for wording in APPLY_WORDING:
        applying = applying | F.contains(squash_lower(F.col("anchor_text")), F.lit(wording))
    rows = links.dropDuplicates([*_PAGE, "position"]).select(
        *_PAGE, "position", "scope", "url", F.when(own, title_before_details(anchor, F.col("url"))).otherwise(anchor).alias("title"),
        (is_http(F.col("url")) & (~own | below)).alias("_place"), (applying & is_http(F.col("url"))).alias("_apply"),
    )
    rows = with_stage(rows, "_role", F.coalesce(F.col("_place") & ~F.col("_apply") & _role_title(F.col("title")), F.lit(False)))
    order = Window.partitionBy(*_PAGE).orderBy("position")
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "rank": F.sum(F.col("_role").cast("int")).over(so_far),
            "role_scope": F.last(F.when(F.col("_role"), F.col("scope")), ignorenulls=True).over(so_far),
            "apply": F.min(F.when(F.col("_apply"), F.struct("position", "url"))).over(from_here),
        }
    )
    marks = rows.groupBy(*_PAGE).agg(F.array_sort(F.collect_list(F.struct("position", "rank", "role_scope", "apply"))).alias("_marks"))
    pages = events.dropDuplicates(list(_PAGE)).filter(F.size("elements") > 0).select(*_PAGE, "elements", "runs").join(marks, list(_PAGE))

    def counted(element: Column, at: Column) -> Column:
        inside, before = F.get("_marks", element["end_link"] - 1), F.get("_marks", element["first_link"] - 1)
        apply = F.get("_marks", element["first_link"])["apply"]
        return F.struct(
            inside["rank"].alias("rank"), (inside["rank"] - F.coalesce(before["rank"], F.lit(0))).alias("roles"), (inside["role_scope"] == element["scope"]).alias("near"),
            element["dated"].alias("dated"), F.when(apply["position"] < element["end_link"], apply["url"]).alias("apply_url"),
            (element["end"] - element["start"]).alias("width"), at.alias("at"), element["start"].alias("start"),
        )

    spans = F.filter(F.transform("elements", counted), lambda e: (e["roles"] == 1) & e["near"] & (e["dated"] >= 0))
    held = pages.select(*_PAGE, F.explode(spans).alias("_span"))
    # Elements are listed inner ones first, so of equally wide ones the innermost has the smallest place.
    picked = held.groupBy(*_PAGE, F.col("_span.rank").alias("rank")).agg(F.min_by("_span", F.struct("_span.width", "_span.at")).alias("_span"))
    per_page = picked.groupBy(*_PAGE).agg(F.collect_list("_span").alias("_spans"))

    def shown(span: Column) -> Column:
        text = F.array_join(F.slice("runs", span["start"] + 1, span["width"]), " ")
        return F.struct(span["rank"].alias("rank"), text.alias("context"), F.get("runs", span["dated"]).alias("dated"), span["apply_url"].alias("apply_url"))

    texts = pages.select(*_PAGE, "runs").join(per_page, list(_PAGE)).select(*_PAGE, F.inline(F.transform("_spans", shown)))
    roles = rows.filter("_role").select(*_PAGE, "position", "url", "title", "rank")
    return roles.join(texts, [*_PAGE, "rank"])


def job_cards(links: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Role cards of a page: JSON-LD postings first, then dated cards around a role link, ranked per page as ``pick``.

    A link on the company's own host must lead below a careers section. Publication needs the current-jobs rules.
    """
    cards = role_cards(links, events).select(
        *_PAGE, "title", F.col("url").alias("role_url"), F.regexp_extract("dated", CARD_DATE, 1).alias("deadline_raw"), squash(F.col("context")).alias("employer_context"),
        F.lit("").alias("hiring_organisation"), F.lit("dated_role_card").alias("method"), F.coalesce("apply_url", "url").alias("application_url"),
        F.when(F.col("apply_url").isNotNull(), "explicit_apply_link").otherwise("role_detail_link").alias("action_type"),
        F.struct(F.lit(1).alias("part"), F.col("position").alias("at")).alias("_at"),
    )
    posting = events.filter(F.size("job_postings") > 0).select(*_PAGE, F.posexplode("job_postings").alias("_i", "node"))

    def member(path: str) -> Column:
        return squash(F.get_json_object("node", path))

    address = resolve_link(F.col("final_url"), member("$.url"))
    structured = posting.select(
        *_PAGE, member("$.title").alias("title"), address.alias("role_url"), member("$.validThrough").alias("deadline_raw"),
        member("$.hiringOrganization.name").alias("employer_context"), member("$.hiringOrganization.name").alias("hiring_organisation"),
        F.lit("jsonld_job_posting").alias("method"), address.alias("application_url"), F.lit("structured_job_posting").alias("action_type"),
        F.struct(F.lit(0).alias("part"), F.col("_i").alias("at")).alias("_at"),
    ).filter(_role_title(F.col("title")) & (F.col("deadline_raw") != "") & is_http(F.col("role_url")))
    rows = structured.unionByName(cards)
    first = _once(rows.withColumn("_key", F.lower("title")), ["org", "final_url", "_key", "role_url"], F.col("_at"))
    return _leading(first.drop("_key"), ["org", "final_url"], [F.col("_at")], limit)


# --- A20, U7: crawl ledger -----------------------------------------------------------------------------------

def missing_seed_events(entities: DataFrame, events: DataFrame) -> DataFrame:
    """A terminal error event for every company with a crawlable website and no event at all."""
    home = normalize_homepage(F.col("website"))
    missing = entities.filter(home.isNotNull()).join(events.select("org"), "org", "left_anti")
    return missing.select(
        "org", home.alias("requested_url"), home.alias("final_url"), F.lit(0).alias("status_code"),
        F.lit("homepage").alias("page_kind"), F.lit("source_error").alias("status"),
        F.lit("No page event emitted; request was rejected before download (for example by robots.txt).").alias("error"),
    )


def latest_homepages(events: DataFrame) -> DataFrame:
    """Latest home-page event per company, combined on the map side."""
    home = events.filter(F.col("page_kind") == "homepage")
    rest = [name for name in home.columns if name != "org"]
    order = F.struct(F.coalesce("retrieved_at", F.lit("")), F.coalesce("final_url", F.lit("")))
    return home.groupBy("org").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("org", "_row.*")


def unique_pages(events: DataFrame) -> DataFrame:
    """One row per company and address of the available events: a home page wins over other kinds."""
    ok = events.filter(F.col("status") == "available")
    rest = [name for name in ok.columns if name not in ("org", "final_url")]
    order = F.struct((F.col("page_kind") == "homepage"), F.coalesce("retrieved_at", F.lit("")))
    return ok.groupBy("org", "final_url").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("org", "final_url", "_row.*")


def crawl_errors(events: DataFrame) -> DataFrame:
    return events.filter(F.col("status") != "available").select("org", F.coalesce("final_url", "requested_url").alias("url"), "error")


def crawl_summary(entities: DataFrame, events: DataFrame) -> DataFrame:
    """Per company: state of the latest home page, pages, errors; companies without a home-page event are not found."""
    home = latest_homepages(events).select("org", F.col("status").alias("_status"), "final_url", "content_sha256")
    counted = events.groupBy("org").agg(
        F.countDistinct(F.when(F.col("status") == "available", F.col("final_url"))).alias("pages"),
        F.count_if(F.col("status") != "available").alias("errors"),
    )
    return entities.select("org").join(home, "org", "left").join(counted, "org", "left").select(
        "org", F.coalesce("_status", F.lit("not_found")).alias("status"), "final_url", "content_sha256",
        F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("errors", F.lit(0)).alias("errors"),
    )


# --- A21: site activity ----------------------------------------------------------------------------------------

NEWS_PATH = r"(?i)/(?:news|press|aktuelt|nyheter|artikler|blog)(?:/|$)"


def site_activity(verified: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """One completeness observation per verified site: pages and published social links."""
    page_counts = pages.groupBy("org").agg(F.count(F.lit(1)).alias("_pages"))
    link_counts = links.groupBy("org").agg(F.count(F.lit(1)).alias("_links"))
    rows = (
        verified.filter(F.length(F.coalesce("content_sha256", F.lit(""))) == 64)
        .join(page_counts, "org", "left")
        .join(link_counts, "org", "left")
        .withColumn("_pages", F.coalesce("_pages", F.lit(0)))
        .withColumn("_links", F.coalesce("_links", F.lit(0)))
    )
    observations = rows.select(
        F.concat_ws("-", F.lit("company-site-activity"), "org", F.substring("content_sha256", 1, 16)).alias("id"),
        "org", F.lit("company_site").alias("platform"), F.lit("profile_metrics").alias("signal_type"),
        F.col("final_url").alias("source_url"), "retrieved_at", "content_sha256", F.lit(True).alias("exact_entity"),
        F.array(F.create_map(F.lit("type"), F.lit("website_identity_gate"))).alias("identity_proof"),
        F.lit("permitted_public_page").alias("acquisition_mode"), F.lit("approved").alias("rights_status"),
        F.lit("company_site").alias("source_class"),
        F.concat(
            F.lit("Site with "), F.col("_pages").cast("string"), F.lit(" pages and "),
            F.col("_links").cast("string"), F.lit(" checked profiles."),
        ).alias("evidence_span"),
        F.create_map(
            F.lit("bounded_pages_captured"), F.col("_pages").cast("string"), F.lit("verified_social_links"), F.col("_links").cast("string")
        ).alias("metrics"),
        F.lit("company_site_activity").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


def site_news(verified: DataFrame, pages: DataFrame) -> DataFrame:
    """One news observation per verified site: the deepest news path wins, then the address."""
    news = pages.filter(url_path(F.col("final_url")).rlike(NEWS_PATH)).select(
        "org", F.col("final_url").alias("url"), "title", F.col("content_sha256").alias("_page_sha"),
        F.size(path_segments(F.col("final_url"))).alias("depth"),
    )
    order = F.struct(-F.col("depth"), F.col("url"))
    best = news.groupBy("org").agg(
        F.min_by(F.struct("url", "title", "_page_sha"), order).alias("p"), F.count(F.lit(1)).alias("_n")
    )
    rows = verified.select("org", "retrieved_at").join(best, "org").filter(
        is_http(F.col("p.url")) & (F.length(F.coalesce("p._page_sha", F.lit(""))) == 64)
    )
    observations = rows.select(
        material_id("company-site-news-", 24, F.col("org"), F.col("p.url")).alias("id"), "org",
        F.lit("company_site").alias("platform"), F.lit("public_post").alias("signal_type"), F.col("p.url").alias("source_url"),
        "retrieved_at", F.col("p._page_sha").alias("content_sha256"), F.lit(True).alias("exact_entity"),
        F.array(F.create_map(F.lit("type"), F.lit("website_identity_gate"))).alias("identity_proof"),
        F.lit("permitted_public_page").alias("acquisition_mode"), F.lit("approved").alias("rights_status"),
        F.lit("company_site").alias("source_class"),
        F.coalesce(F.nullif(F.trim("p.title"), F.lit("")), F.lit("Company news/activity page")).alias("evidence_span"),
        F.create_map(F.lit("captured_news_pages"), F.col("_n").cast("string")).alias("metrics"),
        F.lit("company_site_activity").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


# --- F13: feed candidates ---------------------------------------------------------------------------------------

FEED_PATHS = ("feed/", "rss.xml", "feed.xml", "atom.xml")


def feed_candidates(verified: DataFrame) -> DataFrame:
    """Feed addresses worth fetching per verified site, in a fixed order."""
    origin = F.regexp_extract(F.col("final_url"), r"^(https?://[^/?#]+)", 1)
    rows = verified.filter(origin != "").select(
        "org", F.posexplode(F.array(*[F.concat(origin, F.lit("/" + path)) for path in FEED_PATHS])).alias("position", "url")
    )
    return rows
