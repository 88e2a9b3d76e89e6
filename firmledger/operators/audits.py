"""Audits and comparisons of runs: completeness, coverage gaps, evidence visibility, deltas and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import json_text
from ..functions.values import percentage

# Weights of the completeness score and the maxima of its controller components.
FOUNDATION_WEIGHTS = {
    "official_identity": 5.0, "annual_accounts": 10.0, "roles": 5.0, "locations": 5.0, "website_terminal_state": 5.0,
}
ENRICHMENT_WEIGHTS = {
    "exact_external_identity": 8.0, "verified_handles": 8.0, "profile_metrics": 8.0, "places_identity": 4.0,
    "places_reviews": 8.0, "workforce_jobs": 8.0, "public_buzz": 8.0, "independent_sentiment": 12.0, "freshness_evidence": 6.0,
}
COMPONENT_MAXIMA = {
    "exact_external_identity": 20.0, "verified_handles": 15.0, "profile_metrics": 10.0, "places_identity": 5.0,
    "places_reviews": 10.0, "workforce_jobs": 10.0, "public_buzz": 10.0, "independent_sentiment": 15.0, "freshness_evidence": 5.0,
}
TRACKED_FIELDS = (
    "official_website", "external.profile_handle", "social_links", "external.contact_email", "external.careers_page",
    "external.job_posting", "external.company_update", "external.workforce_snapshot", "official.support_award",
)
IDENTITY_FIELDS = ("official_website", "social_links")


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


# --- A6: completeness ----------------------------------------------------------------------------------

def completeness(orgs: DataFrame, modules: DataFrame, scores: DataFrame) -> DataFrame:
    """Foundation, strict and experimental completeness per company.

    ``scores`` holds the nine components of a company and their ``experimental_`` twins.
    """
    module, status = F.col("module"), F.coalesce("status", F.lit(""))
    ran = ~status.isin("error", "not_run")
    number = F.get_json_object("value", "$.organisation_number")

    def seen(name: str) -> Column:
        return F.coalesce(F.bool_or((module == name) & ran), F.lit(False))

    states = modules.groupBy("org").agg(
        F.coalesce(F.bool_or((module == "registry_live") & (number == F.col("org"))), F.lit(False)).alias("official_identity"),
        F.coalesce(F.bool_or((module == "financials") & (status == "available")), F.lit(False)).alias("annual_accounts"),
        seen("roles").alias("roles"),
        seen("locations").alias("locations"),
        seen("website").alias("website_terminal_state"),
    )
    rows = orgs.select("org").join(states, "org", "left").join(scores, "org", "left")
    foundation = {
        name: F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
        for name, weight in FOUNDATION_WEIGHTS.items()
    }

    def enriched(prefix: str) -> dict[str, Column]:
        return {
            name: F.bround(
                weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(prefix + name), F.lit(0.0)) / COMPONENT_MAXIMA[name])), 3
            )
            for name, weight in ENRICHMENT_WEIGHTS.items()
        }

    base = F.bround(_total(list(foundation.values())), 3)
    strict, trial = enriched(""), enriched("experimental_")
    return rows.select(
        "org",
        base.alias("foundation_score"),
        F.bround(base + _total(list(strict.values())), 3).alias("strict_completeness_score"),
        F.bround(base + _total(list(trial.values())), 3).alias("experimental_completeness_score"),
        *[value.alias(f"foundation_{name}") for name, value in foundation.items()],
        *[value.alias(f"strict_{name}") for name, value in strict.items()],
    )


def completeness_summary(scored: DataFrame, group: str | None = None) -> DataFrame:
    """Means, threshold counts and component coverage, overall or per group column."""
    components = [name for name in scored.columns if name.startswith(("foundation_", "strict_")) and not name.endswith("_score")]

    def mean(name: str) -> Column:
        return F.bround(F.avg(name), 3)

    keys = [group] if group else []
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("companies"),
        mean("foundation_score").alias("foundation_mean"),
        mean("strict_completeness_score").alias("strict_completeness_mean"),
        mean("experimental_completeness_score").alias("experimental_completeness_mean"),
        F.count_if(F.col("strict_completeness_score") >= 50).alias("strict_at_50"),
        F.count_if(F.col("experimental_completeness_score") >= 65).alias("experimental_at_65"),
        *[F.bround(F.avg((F.col(name) > 0).cast("double")), 4).alias(f"coverage_{name}") for name in components],
    )


def completeness_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("strict_completeness_score").agg(F.count(F.lit(1)).alias("companies"))


def retention(summary: DataFrame, group: str, base: str, extension: str) -> DataFrame:
    """Share of the base group's mean scores that the extension group keeps."""

    def of(name: str, label: str) -> Column:
        return F.max(F.when(F.col(group) == label, F.col(name)))

    means = ("foundation_mean", "strict_completeness_mean", "experimental_completeness_mean")
    return summary.agg(
        *[
            F.bround(of(name, extension) / F.nullif(of(name, base), F.lit(0.0)), 4).alias(f"{name}_retention") for name in means
        ]
    )


# --- A8: external gaps ------------------------------------------------------------------------------------

def field_coverage(orgs: DataFrame, claims: DataFrame) -> DataFrame:
    """Companies with an available claim per tracked field, and the share of all companies."""
    spark = orgs.sparkSession
    total = orgs.select("org").distinct().agg(F.count(F.lit(1)).alias("total_companies"))
    have = (
        claims.filter((F.col("availability") == "available") & F.col("field").isin(*TRACKED_FIELDS))
        .groupBy("field")
        .agg(F.countDistinct("org").alias("companies"))
    )
    fields = spark.createDataFrame([(name,) for name in TRACKED_FIELDS], "field string")
    # Nine fields and a one-row total.
    rows = fields.join(have, "field", "left").join(F.broadcast(total), F.lit(True))
    found = F.coalesce("companies", F.lit(0))
    return rows.select(
        "field", found.alias("companies"), "total_companies", percentage(found, F.col("total_companies")).alias("company_coverage_pct")
    )


def site_yield(orgs: DataFrame, claims: DataFrame, sites: DataFrame) -> DataFrame:
    """Yield on verified sites: handles, contacts and home-page surfaces, with the decision per question.

    ``sites`` holds one row per verified site: org and the flags careers_links, news_detail_links, active_hiring and
    job_listing_candidates.
    """
    surfaces = ("careers_links", "news_detail_links", "active_hiring", "job_listing_candidates")
    verified = sites.groupBy("org").agg(*[F.bool_or(F.coalesce(F.col(name), F.lit(False))).alias(name) for name in surfaces])
    ok = claims.filter(F.col("availability") == "available")

    def having(field: str, name: str) -> DataFrame:
        return ok.filter(F.col("field") == field).select("org").distinct().withColumn(name, F.lit(True))

    rows = verified.join(having("external.profile_handle", "handle"), "org", "left").join(
        having("external.contact_email", "email"), "org", "left"
    )
    counted = rows.agg(
        F.count(F.lit(1)).alias("verified_sites"), F.count("handle").alias("profile_handle"), F.count("email").alias("contact_email"),
        *[F.count_if(F.col(name)).alias(name) for name in surfaces],
    )
    total = orgs.select("org").distinct().agg(F.count(F.lit(1)).alias("total"))
    row = counted.join(F.broadcast(total), F.lit(True))  # two one-row tables
    short = F.col("verified_sites") < F.col("total")
    bottleneck, gap = F.lit("source_reach_bottleneck"), F.lit("extractor_or_source_gap")
    none, some = F.lit("no_surface_in_verified_site_sample"), F.lit("measured_surface_available")
    hiring = (F.col("careers_links") + F.col("active_hiring") + F.col("job_listing_candidates")) == 0
    metrics = ("profile_handle", "contact_email", *surfaces)
    decision = {
        "profile_handle": F.when(short & (F.col("profile_handle") > 0), bottleneck).otherwise(gap),
        "contact_email": F.when(
            short & (F.col("contact_email") == F.col("verified_sites")) & (F.col("verified_sites") > 0), bottleneck
        ).otherwise(gap),
        "careers_links": F.when(hiring, none).otherwise(some),
        "active_hiring": F.when(hiring, none).otherwise(some),
        "job_listing_candidates": F.when(hiring, none).otherwise(some),
        "news_detail_links": F.when(F.col("news_detail_links") == 0, none).otherwise(some),
    }
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"), F.col(name).alias("companies"),
                percentage(F.col(name), F.col("verified_sites")).alias("conditional_yield_pct"), decision[name].alias("decision"),
            )
            for name in metrics
        ]
    )
    return row.select("verified_sites", F.inline(cells))


def duplicate_numbers(rows: DataFrame) -> DataFrame:
    """Rows beyond the first per company."""
    return rows.agg((F.count("org") - F.countDistinct("org")).alias("duplicates"))


# --- A9: evidence visibility --------------------------------------------------------------------------------

def _present(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def with_marks(evidence: DataFrame) -> DataFrame:
    """Evidence rows with what :func:`marked_visibility` asks of each, as truth values."""
    return evidence.withColumns({
        "_source_url": _present("source_url"), "_retrieved_at": _present("retrieved_at"), "_claim_span": _present("claim_span"),
        "_content_sha256": F.coalesce("content_sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$"),
        "_reopenable_source_url": F.coalesce("source_url", F.lit("")).rlike(r"^https?://[^/?#]+"),
        "_company": F.coalesce(F.col("source_class") == "company_owned", F.lit(False)), "_proof": _present("identity_proof"),
        "_method": _present("extraction_method"), "_dated": _present("effective_at") | _present("as_of"),
    })


def claim_visibility(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per available claim: what its evidence shows and what is missing."""
    return marked_visibility(claims, with_marks(evidence))


def marked_visibility(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """:func:`claim_visibility` over evidence that has its marks."""
    checks = ("source_url", "retrieved_at", "claim_span", "content_sha256", "reopenable_source_url")
    marks = [f"_{name}" for name in checks]
    ok = claims.filter(F.col("availability") == "available")
    refs = ok.select(
        "org", "claim_order", "field", _present("reporting_period").alias("_period"), F.explode_outer("evidence_ids").alias("id"),
    )
    backing = evidence.select("org", "id", *marks, "_company", "_proof", "_method", "_dated", F.lit(True).alias("_known"))
    joined = refs.join(backing, ["org", "id"], "left")
    known = F.coalesce("_known", F.lit(False))

    def every(condition: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(known, condition)), F.lit(True))

    def some(condition: Column) -> Column:
        return F.coalesce(F.bool_or(known & condition), F.lit(False))

    per_claim = joined.groupBy("org", "claim_order", "field").agg(
        F.coalesce(F.bool_or(known), F.lit(False)).alias("_backed"),
        F.count_if(F.col("id").isNotNull() & ~known).alias("missing_references"),
        *[every(F.col(name)).alias(name) for name in marks],
        some(F.col("_company")).alias("_owned"),
        some(F.col("_proof")).alias("identity_proof_visible"),
        some(F.col("_method")).alias("extraction_method_visible"),
        (some(F.col("_dated")) | F.coalesce(F.bool_or("_period"), F.lit(False))).alias("date_visible"),
    )
    sensitive = (
        F.col("field").isin(*IDENTITY_FIELDS) | F.startswith("field", F.lit("external.")) | F.startswith("field", F.lit("official.support_"))
        | F.col("_owned")
    )
    missing = F.array_compact(
        F.array(
            F.when(~F.col("_backed"), F.lit("evidence")),
            *[F.when(F.col("_backed") & ~F.col(f"_{name}"), F.lit(name)) for name in checks],
        )
    )
    rows = per_claim.withColumn("identity_sensitive", sensitive).withColumn("missing_core", missing)
    trace = F.array_compact(
        F.array(
            F.when(F.col("identity_sensitive") & ~F.col("identity_proof_visible"), F.lit("identity_proof")),
            F.when(F.col("identity_sensitive") & ~F.col("extraction_method_visible"), F.lit("extraction_method")),
        )
    )
    return rows.select(
        "org", "claim_order", "field", "missing_core", "missing_references",
        ((F.size("missing_core") == 0) & (F.col("missing_references") == 0)).alias("core_complete"),
        (F.col("_backed") & F.col("_reopenable_source_url")).alias("reopenable"), "identity_sensitive", "identity_proof_visible",
        "extraction_method_visible", "date_visible", trace.alias("missing_trace"),
    )


def visibility_by_field(visibility: DataFrame) -> DataFrame:
    sensitive = F.col("identity_sensitive")
    return visibility.groupBy("field").agg(
        F.count(F.lit(1)).alias("available_claims"),
        F.count_if("core_complete").alias("core_evidence_complete"),
        F.count_if("reopenable").alias("reopenable_source"),
        F.count_if(sensitive).alias("identity_sensitive_claims"),
        F.count_if(sensitive & F.col("identity_proof_visible")).alias("identity_proof_visible"),
        F.count_if(sensitive & F.col("extraction_method_visible")).alias("extraction_method_visible"),
        F.count_if("date_visible").alias("date_visible"),
    )


def visibility_issues(visibility: DataFrame) -> DataFrame:
    """(org, field, missing) of every claim that lacks something."""
    gone = F.when(F.col("missing_references") > 0, F.array(F.lit("referenced_evidence"))).otherwise(F.array().cast("array<string>"))
    everything = F.array_sort(F.array_distinct(F.concat("missing_core", gone, "missing_trace")))
    return visibility.select("org", "claim_order", "field", F.explode(everything).alias("missing"))


# --- A15, A16: narrative and description audits ---------------------------------------------------------------

def projection_gain(before: DataFrame, after: DataFrame, field: str) -> DataFrame:
    """Companies with an available claim of a field before and after a projection, and the net gain."""

    def having(claims: DataFrame, name: str) -> DataFrame:
        rows = claims.filter((F.col("field") == field) & (F.col("availability") == "available"))
        return rows.select("org").distinct().withColumn(name, F.lit(True))

    both = having(before, "_before").join(having(after, "_after"), "org", "full_outer")
    return both.agg(
        F.lit(field).alias("field"), F.count("_before").alias("before"), F.count("_after").alias("after"),
        F.count_if(F.col("_before").isNull()).alias("net_new"), F.count_if(F.col("_after").isNull()).alias("lost"),
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that two tables hold unequally often, with ``surplus``: how many more the left one has (below 0: the right one).

    Both differences come from one pass over either table; equal rows of a task are added up before the shuffle.
    """
    both = left.withColumn("surplus", F.lit(1)).unionByName(right.withColumn("surplus", F.lit(-1)))
    return both.groupBy(*left.columns).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as multisets; two zeros mean the tables are equal."""
    n = F.col("surplus")
    return multiset_difference(left, right).agg(
        F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-n, F.lit(0))), F.lit(0)).alias("only_right")
    )


def description_audit(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """Annual-report descriptions: duplicates, claims without observation, suppressed ones, and shared reports."""
    strategy = "annual_report_company_description_exact_org_v3"
    rows = observations.filter(F.col("strategy") == strategy)
    stated = claims.filter((F.col("field") == "company_description") & (F.col("platform") == "brreg")).select(
        "org", F.col("observation_id").alias("id")
    )
    per_company = rows.groupBy("org").agg(F.count(F.lit(1)).alias("n"))
    per_report = rows.groupBy("content_sha256").agg(F.countDistinct("org").alias("n"))
    parts = [
        ("observations", rows),
        ("companies_with_duplicates", per_company.filter("n > 1")),
        ("claims_without_observation", stated.join(rows.select("org", "id"), ["org", "id"], "left_anti")),
        ("suppressed_observations", rows.join(stated, ["org", "id"], "left_anti")),
        ("reports_shared_by_companies", per_report.filter("n > 1")),
    ]
    result = None
    for name, part in parts:
        row = part.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("n"))
        result = row if result is None else result.unionByName(row)
    return result


# --- A18: foundation ratios -----------------------------------------------------------------------------------------

def foundation_ratios(orgs: DataFrame, modules: DataFrame) -> DataFrame:
    """Shares of all companies with exact live identity, accounts, roles and locations, and a website state."""
    module = F.col("module")
    number = F.get_json_object("value", "$.organisation_number")
    # Told row by row before the shuffle: answers of modules whose values are not looked at need not be made.
    told = modules.select(
        "org",
        ((module == "registry_live") & (number == F.col("org"))).alias("exact"),
        ((module == "financials") & (F.col("status") == "available")).alias("accounts"),
        (module == "roles").alias("roles"), (module == "locations").alias("locations"), (module == "website").alias("site"),
    )
    states = told.groupBy("org").agg(
        F.bool_or("exact").alias("exact"), F.bool_or("accounts").alias("accounts"),
        (F.bool_or("roles") & F.bool_or("locations")).alias("places"), F.bool_or("site").alias("site"),
    )
    rows = orgs.select("org").join(states, "org", "left")

    def share(name: str) -> Column:
        value = F.avg(F.coalesce(F.col(name), F.lit(False)).cast("double"))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))

    return rows.agg(
        share("exact").alias("official_identity"), share("accounts").alias("annual_accounts"),
        share("places").alias("roles_and_locations"), share("site").alias("website_terminal_state"),
    )


# --- U1 to U5: run deltas -----------------------------------------------------------------------------------------------

def claim_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and removed available claims as multisets of (org, field, value)."""

    def keys(claims: DataFrame) -> DataFrame:
        return claims.filter(F.col("availability") == "available").select("org", "field", "value")

    change = F.when(F.col("surplus") > 0, F.lit("added")).otherwise(F.lit("removed"))
    return multiset_difference(keys(after), keys(before)).select(
        change.alias("change"), "org", "field", "value", F.abs("surplus").alias("claims")
    )


def claim_delta_by_field(delta: DataFrame) -> DataFrame:
    return delta.groupBy("change", "field").agg(F.sum("claims").alias("claims"))


def claim_delta_details(delta: DataFrame, change: str, limit: int | None = None) -> DataFrame:
    """Rows of a delta in key order; a limit keeps the first ones for a report."""
    rows = delta.filter(F.col("change") == change).orderBy("org", "field", "value")
    return rows if limit is None else rows.limit(limit)


def coverage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Companies gained and lost per tracked field."""

    def covered(claims: DataFrame) -> DataFrame:
        ok = (F.col("availability") == "available") & F.col("field").isin(*TRACKED_FIELDS)
        return claims.filter(ok).select("field", "org")

    both = covered(after).withColumn("_new", F.lit(True)).unionByName(covered(before).withColumn("_new", F.lit(False)))
    sides = both.groupBy("field", "org").agg(F.bool_or("_new").alias("_after"), F.bool_or(~F.col("_new")).alias("_before"))
    change = F.when(F.col("_after"), F.lit("gained")).otherwise(F.lit("lost"))
    return sides.filter(F.col("_after") != F.col("_before")).select("field", "org", change.alias("change"))


def forbidden_publications(claims: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Available claims whose value holds a text that must not be published for that company."""
    needles = forbidden.select("org", F.lower("needle").alias("needle")).filter(F.col("needle") != "").distinct()
    rows = claims.filter(F.col("availability") == "available").join(needles, "org")
    return rows.filter(F.contains(F.lower(F.coalesce("value", F.lit(""))), F.col("needle"))).select("org", "field", "needle")


def guard_replay(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """What a guard removed, and whether it added or changed anything (which it must not)."""
    old, new = before.select(*columns), after.select(*columns)
    return table_difference(old, new).select(F.col("only_left").alias("removed"), F.col("only_right").alias("added_or_changed"))


# --- P25: re-projection report --------------------------------------------------------------------------------------------

def reprojection_report(before: DataFrame, after: DataFrame, errors: DataFrame) -> DataFrame:
    """Observations per platform after a rule change, companies on both sides, and errors, as (metric, label, n)."""
    platforms = after.groupBy(F.col("platform").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    parts = [platforms.select(F.lit("observations_by_platform").alias("metric"), "label", "n")]
    old, new = before.select("org").distinct(), after.select("org").distinct()
    for label, rows in (
        ("before", old), ("after", new), ("only_before", old.join(new, "org", "left_anti")), ("only_after", new.join(old, "org", "left_anti")),
    ):
        parts.append(rows.agg(F.lit("companies").alias("metric"), F.lit(label).alias("label"), F.count(F.lit(1)).alias("n")))
    parts.append(errors.agg(F.lit("errors").alias("metric"), F.lit("all").alias("label"), F.count(F.lit(1)).alias("n")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def website_of_claims(claims: DataFrame) -> DataFrame:
    """Published website per company."""
    rows = claims.filter((F.col("field") == "official_website") & (F.col("availability") == "available"))
    return rows.groupBy("org").agg(F.min_by(json_text(F.col("value")), F.col("claim_order")).alias("website"))
