"""Small domain expressions: bands, classes, confidences, percentages and registry-change wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Registry paths with a stable meaning; an exact path wins over a prefix.
EXACT_PATH_LABELS = {
    "/sisteInnsendteAarsregnskap": "latest submitted annual accounts",
    "/antallAnsatte": "registered employee count",
    "/naeringskode1": "registered industry",
    "/vedtektsdato": "articles date",
    "/registrertIMvaregisteret": "VAT registration status",
    "/registreringsdatoMerverdiavgiftsregisteret": "VAT registration date",
    "/registreringsdatoFrivilligMerverdiavgiftsregisteret": "voluntary VAT registration date",
    "/kapital/antallAksjer": "registered share count",
    "/kapital/innfortDato": "registered capital effective date",
}
PREFIX_PATH_LABELS = {
    "/forretningsadresse/": "registered business address",
    "/postadresse/": "registered postal address",
    "/kapital/": "registered capital",
}
# Module status to claim availability; not_fetched makes no claim.
STATUS_TO_AVAILABILITY = {
    "available": "available",
    "not_found": "not_available",
    "blocked": "blocked",
    "not_applicable": "not_applicable",
    "source_error": "failed",
}


def employee_band(employees: Column) -> Column:
    return (
        F.when(employees.isNull(), F.lit("missing"))
        .when(employees == 0, F.lit("0"))
        .when(employees < 5, F.lit("1-4"))
        .when(employees < 20, F.lit("5-19"))
        .when(employees < 100, F.lit("20-99"))
        .otherwise(F.lit("100+"))
    )


def _web_mark(website: Column) -> Column:
    return F.when(F.coalesce(website, F.lit("")) != "", F.lit("web")).otherwise(F.lit("no-web"))


def stratum(legal_form: Column, employees: Column, adverse: Column, website: Column) -> Column:
    """Stress stratum: form group, employee band, state and web presence."""
    form = F.when(legal_form.isin("AS", "ASA", "ENK"), legal_form).otherwise(F.lit("OTHER"))
    state = F.when(adverse, F.lit("adverse")).otherwise(F.lit("active"))
    return F.concat_ws("|", form, employee_band(employees), state, _web_mark(website))


def filer_stratum(
    legal_form: Column, employees: Column, industry_code: Column, municipality_number: Column, website: Column
) -> Column:
    """Reporting stratum: form, employee band, industry division, county and web presence."""

    def known(column: Column) -> Column:
        return F.when(F.coalesce(column, F.lit("")) == "", F.lit("missing")).otherwise(column)

    return F.concat_ws(
        "|",
        known(legal_form),
        employee_band(employees),
        F.element_at(F.split(known(industry_code), r"\."), 1),
        F.substring(known(municipality_number), 1, 2),
        _web_mark(website),
    )


def source_class(source: Column) -> Column:
    """Fold source names to official, company_owned, or the name itself."""
    name = F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))
    low = F.lower(name)
    official = (
        F.startswith(low, F.lit("official_"))
        | F.contains(low, F.lit("brreg"))
        | (F.contains(low, F.lit("registry")) & ~F.contains(low, F.lit("website")))
    )
    owned = (
        F.contains(low, F.lit("website")) | F.contains(low, F.lit("company_site")) | F.contains(low, F.lit("company_owned"))
    )
    return F.when(official, F.lit("official")).when(owned, F.lit("company_owned")).otherwise(name)


def availability(status: Column) -> Column:
    """Claim availability of a module status; null for not_fetched, failed for the unknown."""
    mapped = F.lit(None).cast("string")
    for name, state in STATUS_TO_AVAILABILITY.items():
        mapped = F.when(status == name, F.lit(state)).otherwise(mapped)
    return F.when(F.coalesce(status, F.lit("")) == "not_fetched", F.lit(None).cast("string")).otherwise(
        F.coalesce(mapped, F.lit("failed"))
    )


def claim_confidence(state: Column, identity_score: Column, source: Column) -> Column:
    """1.0 for anything but an available value; else the clamped identity score, 1.0 official, 0.95 otherwise."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), identity_score))
    fallback = F.when(source_class(source) == "official", F.lit(1.0)).otherwise(F.lit(0.95))
    return F.when(state != "available", F.lit(1.0)).otherwise(F.coalesce(clamped, fallback))


def clamped_score(score: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.try_cast("double"), F.lit(default))))


def percentage(numerator: Column, denominator: Column) -> Column:
    """Percentage with one decimal, half to even, zero for an empty base."""
    ratio = numerator.cast("double") * 100.0 / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(F.bround(ratio, 1))


def path_label(path: Column) -> Column:
    """Label of a registry change path; null when the path has no stable meaning."""
    text = F.trim(F.coalesce(path, F.lit("")))
    label = F.lit(None).cast("string")
    for prefix, name in reversed(list(PREFIX_PATH_LABELS.items())):
        label = F.when(F.startswith(text, F.lit(prefix)), F.lit(name)).otherwise(label)
    for exact, name in EXACT_PATH_LABELS.items():
        label = F.when(text == exact, F.lit(name)).otherwise(label)
    return label


def render_registry_value(value_json: Column) -> Column:
    """Readable form of a JSON value: ``description (code)``, the first four of a list, ``removed`` for null."""
    raw = F.trim(value_json)

    def member(*names: str) -> Column:
        found = [F.nullif(F.trim(F.get_json_object(raw, f"$.{name}")), F.lit("")) for name in names]
        return F.coalesce(*found)

    description, code = member("beskrivelse", "description"), member("kode", "code")
    as_object = F.coalesce(
        F.when(description.isNotNull() & code.isNotNull(), F.concat(description, F.lit(" ("), code, F.lit(")"))),
        description,
        code,
        raw,
    )
    items = F.from_json(raw, "array<string>")
    as_list = F.array_join(items, ", ")
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return (
        F.when(raw.isNull() | (raw == "null"), F.lit("removed"))
        .when(F.startswith(raw, F.lit("{")), as_object)
        .when(F.startswith(raw, F.lit("[")), as_list)
        .otherwise(F.coalesce(scalar, raw))
    )


def change_summary(changes: Column) -> Column:
    """All distinct-label phrases of an ordered array of (label, operation, value)."""
    labels = F.transform(changes, lambda item: item["label"])
    first_seen = F.filter(changes, lambda item, index: F.array_position(labels, item["label"]) == index + 1)

    def phrase(item: Column) -> Column:
        value = render_registry_value(item["value"])
        return (
            F.when(item["operation"] == "remove", F.concat(item["label"], F.lit(" removed")))
            .when(item["operation"] == "add", F.concat(item["label"], F.lit(" added: "), value))
            .otherwise(F.concat(item["label"], F.lit(" updated: "), value))
        )

    return F.array_join(F.transform(first_seen, phrase), "; ")


def review_label(stars: Column) -> Column:
    """Review sentiment by star rating: two and below negative, four and up positive, else neutral."""
    return F.when(stars <= 2, F.lit("negative")).when(stars >= 4, F.lit("positive")).otherwise(F.lit("neutral"))
