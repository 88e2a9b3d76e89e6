"""Support awards: exact-recipient matching, newest per company, observations and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_json, material_id
from ..model import CLAIM, EVIDENCE, conform

# Fixed values of the award source.
AWARD_SOURCE_URL = "https://stotte.brreg.no/nb/oppslag/stoettetildeling/totalbestand/csv"
AWARD_EXTRACTION_METHOD = "official_support_registry_primary_recipient_exact_org_v1"
AWARD_FIELD = "official.support_award"
AWARD_SIGNAL = "official_support_award"
AWARD_SCOPE = "official_recipient_support_event"


def awards_of_targets(awards: DataFrame, targets: DataFrame) -> DataFrame:
    """Award rows of target companies; a row that names several recipients counts for each of them."""
    return awards.withColumn("org", F.explode("recipient_orgs")).join(targets.select("org"), "org", "left_semi")


def within_lookback(day: Column, as_of: str, lookback_days: int) -> Column:
    """Both ends inclusive; nothing after the reference day."""
    end = F.lit(as_of).cast("date")
    return day.between(F.date_sub(end, lookback_days), end)


def award_evidence_span(org: Column) -> Column:
    """Readable evidence text of one award row."""

    def labelled(label: str, column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(label), F.col(column)))

    interval_known = F.col("interval_from_text").isNotNull() | F.col("interval_to_text").isNotNull()
    interval = F.concat(
        F.lit("awarded amount interval: "),
        F.coalesce("interval_from_text", F.lit("?")),
        F.lit(".."),
        F.coalesce("interval_to_text", F.lit("?")),
        F.lit(" "),
        F.coalesce("interval_currency", F.lit("")),
    )
    parts = (
        F.concat(F.lit("recipient org: "), org),
        labelled("recipient: ", "recipient_name"),
        labelled("also named: ", "specified_recipient_org"),
        F.concat(F.lit("award date: "), F.coalesce("award_date_text", F.lit(""))),
        F.when(
            F.col("amount_text").isNotNull(),
            F.trim(F.concat(F.lit("awarded amount: "), F.col("amount_text"), F.lit(" "), F.coalesce("currency", F.lit("")))),
        ),
        F.when(interval_known, F.trim(interval)),
        labelled("support measure: ", "measure_number"),
        labelled("support type: ", "measure_type"),
        labelled("granting authority org: ", "giver_org"),
        labelled("granting authority: ", "giver_name"),
        labelled("status: ", "status"),
    )
    return F.concat_ws("; ", *parts)


def newest_awards(
    awards: DataFrame, targets: DataFrame, as_of: str, lookback_days: int = 365, per_company: int = 5
) -> DataFrame:
    """Newest awards per target company inside the lookback window, by date then id, both descending.

    The date filter runs before the recipient explode and join. The row-number filter becomes a group limit
    in every map task, so a company with most of the awards never reaches one task whole.
    """
    recent = awards.filter(within_lookback(F.col("award_date"), as_of, lookback_days))
    matched = awards_of_targets(recent, targets).withColumn(
        "id", material_id("support-award-", 24, F.col("org"), F.col("award_date"), F.col("row_sha256"))
    )
    newest = Window.partitionBy("org").orderBy(F.col("award_date").desc(), F.col("id").desc())
    return (
        matched.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= per_company)
        .withColumn("evidence_span", award_evidence_span(F.col("org")))
    )


def award_event_json() -> Column:
    """The award as a JSON value with sorted keys and explicit nulls."""
    amount = F.regexp_replace(F.regexp_replace(F.col("amount").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return canonical_json(
        {
            "kind": F.lit("support_award"),
            "awarded_at": F.col("award_date").cast("string"),
            "amount": amount,
            "currency": F.col("currency"),
            "amount_interval_from": F.col("interval_from").cast("string"),
            "amount_interval_to": F.col("interval_to").cast("string"),
            "amount_interval_currency": F.col("interval_currency"),
            "support_measure_number": F.col("measure_number"),
            "support_measure_type": F.col("measure_type"),
            "recipient_name": F.col("recipient_name"),
            "specified_recipient_organisation_number": F.col("specified_recipient_org"),
            "granting_authority_org": F.col("giver_org"),
            "granting_authority_name": F.col("giver_name"),
            "status": F.col("status"),
        }
    )


def award_claims(selected: DataFrame, retrieved_at: str) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence of selected awards."""
    evidence_id = material_id("ev-support-", 20, F.col("org"), F.col("id"), F.lit(AWARD_SOURCE_URL), F.col("row_sha256"))
    rows = selected.withColumn("evidence_id", evidence_id)
    claims = rows.select(
        "org",
        F.concat(F.lit("70|"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("claim_order"),
        F.lit(AWARD_FIELD).alias("field"),
        award_event_json().alias("value"),
        F.lit("available").alias("availability"),
        F.lit(1.0).alias("confidence"),
        F.array("evidence_id").alias("evidence_ids"),
        F.lit("brreg").alias("platform"),
        F.lit(AWARD_SIGNAL).alias("signal_type"),
        F.col("id").alias("observation_id"),
        F.lit(AWARD_SCOPE).alias("claim_scope"),
    )
    evidence = rows.select(
        "org",
        F.col("evidence_id").alias("id"),
        F.lit(AWARD_SOURCE_URL).alias("source_url"),
        F.lit("official").alias("source_class"),
        F.lit(retrieved_at).alias("retrieved_at"),
        F.col("row_sha256").alias("content_sha256"),
        F.col("evidence_span").alias("claim_span"),
        F.col("award_date").cast("string").alias("effective_at"),
        F.coalesce("measure_number", F.concat(F.lit("row-"), F.col("row_sha256"))).alias("source_row_key"),
        F.lit(AWARD_EXTRACTION_METHOD).alias("extraction_method"),
    )
    return conform(claims, CLAIM), conform(evidence, EVIDENCE)
