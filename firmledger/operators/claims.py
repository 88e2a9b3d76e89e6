"""Claim and evidence tables: projection, idempotent replacement and validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import (
    json_member, json_object, json_text, json_value, material_id, variant_member, variant_text,
)
from ..functions.staging import bound, unless
from ..functions.text import squash
from ..functions.values import availability, claim_confidence, source_class
from ..model import CLAIM, EVIDENCE, OBSERVATION, conform, union_all
from .cohorts import accounting_obligation

ALLOWED_AVAILABILITY = ("available", "not_available", "blocked", "not_applicable", "ambiguous", "failed")
CORE_FIELDS = {
    "legal_name": "name",
    "legal_form": "legal_form",
    "employee_count": "employees",
    "municipality": "municipality",
    "industry": "industry",
    "latest_submitted_accounts": "latest_submitted_accounts",
}
FINANCIAL_FIELDS = (
    "revenue", "operating_result", "profit_before_tax", "annual_result", "assets", "equity", "debt",
)
STRUCTURED_MODULES = {
    "accounting_obligation": "accounting_obligation",
    "roles": "roles",
    "group": "group_structure",
    "locations": "locations",
}
# Live-registry claim fields and the source paths they resolve from.
LIVE_SOURCE_PATHS = {
    "industry": "/naeringskode1",
    "municipality_number": "/forretningsadresse/kommunenummer",
    "bankrupt": "/konkurs",
    "liquidating": "/underAvvikling",
    "forced_dissolution": "/underTvangsavviklingEllerTvangsopplosning",
    "registration_date": "/registreringsdatoEnhetsregisteret",
    "foundation_date": "/stiftelsesdato",
    "articles_date": "/vedtektsdato",
    "registered_in_enterprise_register": "/registrertIForetaksregisteret",
    "enterprise_register_date": "/registreringsdatoForetaksregisteret",
    "institutional_sector": "/institusjonellSektorkode",
    "registered_capital": "/kapital",
    "registered_in_vat_register": "/registrertIMvaregisteret",
    "vat_registration_date": "/registreringsdatoMerverdiavgiftsregisteret",
    "registered_address": "/forretningsadresse",
    "postal_address": "/postadresse",
    "registered_contact_email": "/epostadresse",
    "registered_phone": "/telefon",
    "registered_mobile": "/mobil",
}
LIVE_SIGNAL = "official_registry_live_projection"
OLD_LIVE_SIGNAL = "official_registry_projection"
NARRATIVE_SIGNAL = "official_registry_narrative_projection"
_ADDRESS_KEYS = ("adresse", "postnummer", "poststed", "kommune", "kommunenummer", "land", "landkode")
_CAPITAL_KEYS = ("belop", "antallAksjer", "type", "bundet", "valuta", "innbetalt", "fulltInnbetalt", "innfortDato")


# --- building blocks ---------------------------------------------------------------------------

def settled_drafts(drafts: DataFrame) -> DataFrame:
    """Claims with the evidence row of each in a struct ``backing``, from draft rows.

    A draft holds the claim (field, value, state, claim_span) and the module record it rests on. A null state
    (nothing fetched) makes no claim; a value survives only when the state is available.
    """
    source = F.col("source_type")
    rows = drafts.filter(F.col("state").isNotNull()).withColumn(
        "_id",
        material_id(
            "ev-", 20, F.col("org"), F.concat(F.col("evidence_key"), F.lit(":"), F.col("field")),
            F.col("source_url"), F.col("content_sha256"), F.col("source_row_key"),
        ),
    )
    span = F.coalesce(
        F.nullif(F.col("claim_span"), F.lit("")), F.nullif(F.trim("note"), F.lit("")), F.col("value"), F.col("status")
    )
    claims = rows.select(
        "org",
        "claim_order",
        "field",
        F.when(F.col("state") == "available", F.col("value")).alias("value"),
        F.col("state").alias("availability"),
        claim_confidence(F.col("state"), F.col("identity_score"), source).alias("confidence"),
        F.array("_id").alias("evidence_ids"),
        "currency",
        "reporting_period",
        F.struct(
            F.col("_id").alias("id"), "source_url", source_class(source).alias("source_class"), "retrieved_at", "content_sha256",
            span.alias("claim_span"), "as_of", "effective_at", "source_row_key",
        ).alias("backing"),
    )
    return conform(claims, T.StructType([*CLAIM.fields, claims.schema["backing"]]))


def split_settled(settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence of :func:`settled_drafts`."""
    evidence = settled.select("org", "backing.*", F.col("claim_order").alias("_order"))
    return settled.select(*CLAIM.fieldNames()), conform(last_by(evidence, ["org", "id"], "_order"), EVIDENCE)


def split_drafts(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence from draft rows."""
    return split_settled(settled_drafts(drafts))


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by an order column, combined on the map side."""
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*")


def evidence_refs(claims: DataFrame) -> DataFrame:
    """Distinct (org, id) pairs that claims point to."""
    return claims.select("org", F.explode("evidence_ids").alias("id")).distinct()


def replace_managed(
    claims: DataFrame,
    evidence: DataFrame,
    managed: Column,
    new_claims: DataFrame,
    new_evidence: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Replace the claims a projector manages, and the evidence that only those used.

    Running it twice changes nothing. The joins run on (org, evidence id), so a company with very many claims
    still spreads over all tasks.
    """
    owned = F.coalesce(managed, F.lit(False))
    kept = claims.filter(~owned)
    orphaned = evidence_refs(claims.filter(owned)).join(evidence_refs(kept), ["org", "id"], "left_anti")
    rest = evidence.join(orphaned, ["org", "id"], "left_anti").join(
        new_evidence.select("org", "id"), ["org", "id"], "left_anti"
    )
    return kept.unionByName(new_claims), rest.select(*evidence.columns).unionByName(new_evidence.select(*evidence.columns))


def replace_claims(claims: DataFrame, families: list[tuple[Column, DataFrame]]) -> DataFrame:
    """The claims of :func:`replace_families` alone."""
    managed = reduce(lambda left, right: left | right, [F.coalesce(owned, F.lit(False)) for owned, _ in families])
    return claims.filter(~managed).unionByName(union_all(*[new for _, new in families]))


def replace_families(
    claims: DataFrame, evidence: DataFrame, families: list[tuple[Column, tuple[DataFrame, DataFrame]]]
) -> tuple[DataFrame, DataFrame]:
    """Replace several claim families in one pass: every table is read once, however many families there are."""
    managed = reduce(lambda left, right: left | right, [F.coalesce(owned, F.lit(False)) for owned, _ in families])
    new_claims = union_all(*[pair[0] for _, pair in families])
    new_evidence = union_all(*[pair[1] for _, pair in families])
    return replace_managed(claims, evidence, managed, new_claims, new_evidence)


def replaced_evidence(settled: DataFrame, managed: Column, new_evidence: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The evidence of :func:`replace_managed` over :func:`settled_drafts`, dealt out by (org, id) only once.

    ``shape`` adds columns to evidence rows, each from its own row. What a reader leaves out of the result is not dealt out,
    so a reader that looks at marks of a row adds them here and the row's texts stay where they are.
    """
    old = settled.select("org", "backing.*", F.col("claim_order").alias("_order"))
    owned = evidence_refs(settled.filter(F.coalesce(managed, F.lit(False))))
    # Claims that were never replaced hold none of the managed ones; then no evidence can be orphaned.
    if not owned.isEmpty():
        kept = evidence_refs(settled.filter(~F.coalesce(managed, F.lit(False))))
        old = old.join(owned.join(kept, ["org", "id"], "left_anti"), ["org", "id"], "left_anti")
    extra = T.StructField("_order", T.StringType())
    rows = shape(conform(old, T.StructType([*EVIDENCE.fields, extra]))).withColumn("_new", F.lit(False)).unionByName(
        shape(conform(new_evidence, T.StructType([*EVIDENCE.fields, extra]))).withColumn("_new", F.lit(True))
    )
    # New rows stand before old ones of their id, and of the old ones the last in claim order.
    rank = F.row_number().over(Window.partitionBy("org", "id").orderBy(F.col("_new").desc(), F.col("_order").desc()))
    return rows.withColumn("_rank", rank).filter(F.col("_new") | (F.col("_rank") == 1)).drop("_order", "_new", "_rank")


# --- P1: base claims ---------------------------------------------------------------------------

_RECORD = (
    "status", "source_type", "source_url", "retrieved_at", "content_sha256", "source_row_key", "as_of", "effective_at",
    "note",
)


def _draft(field: str | Column, value: Column, state: Column, span: Column, key: str | Column, order: str | Column, **extra: Column) -> Column:
    def literal(item: str | Column) -> Column:
        return F.lit(item) if isinstance(item, str) else item

    null = F.lit(None).cast("string")
    return F.struct(
        literal(order).alias("claim_order"),
        literal(key).alias("evidence_key"),
        literal(field).alias("field"),
        value.alias("value"),
        state.alias("state"),
        span.alias("claim_span"),
        extra.get("currency", null).alias("currency"),
        extra.get("reporting_period", null).alias("reporting_period"),
        extra.get("identity_score", F.lit(None).cast("double")).alias("identity_score"),
    )


def _registry_drafts(entities: DataFrame, modules: DataFrame) -> DataFrame:
    records = modules.filter(F.col("module") == "registry").select("org", *_RECORD)
    drafts = []
    for position, (field, column) in enumerate(CORE_FIELDS.items()):
        if column not in entities.columns:
            continue
        value = F.col(f"e.{column}")
        state = F.when(value.isNotNull(), F.lit("available"))
        span = F.concat(F.lit(f"{field}="), value.cast("string"))
        drafts.append(_draft(field, json_value(value), state, span, "registry", f"10|{position:06d}"))
    return (
        entities.alias("e")
        .join(records.alias("r"), "org")
        .select("org", *[f"r.{name}" for name in _RECORD], F.explode(F.array(*drafts)).alias("d"))
        .select("org", *_RECORD, "d.*")
    )


def _website_drafts(modules: DataFrame) -> DataFrame:
    rows = modules.filter(F.col("module") == "website")
    value = F.col("value")
    score = F.get_json_object(value, "$.identity_assessment.score").try_cast("double")
    publishable = F.coalesce(F.get_json_object(value, "$.identity_assessment.publishable") == "true", F.lit(False))
    state = availability(F.col("status"))
    state = F.when((state == "available") & ~publishable, F.lit("ambiguous")).otherwise(state)
    final_url = F.coalesce(F.nullif(F.get_json_object(value, "$.final_url"), F.lit("")), F.col("source_url"))
    description = F.trim(F.coalesce(F.get_json_object(value, "$.description"), F.lit("")))
    links = json_member(value, "$.social_links")
    site_span = F.when(state == "available", F.concat(F.lit("Own website: "), final_url)).otherwise(
        F.coalesce(F.nullif(F.col("note"), F.lit("")), F.lit("Website identity not publishable"))
    )
    drafts = F.array(
        _draft("official_website", json_value(final_url), state, site_span, "website", "20|000000", identity_score=score),
        _draft(
            "company_description", json_value(description),
            F.when((state == "available") & (description != ""), F.lit("available")), description,
            "website", "20|000001", identity_score=score,
        ),
        _draft(
            "social_links", links, F.when((state == "available") & links.isNotNull(), F.lit("available")),
            F.concat(F.lit("Profiles linked from "), final_url), "website", "20|000002", identity_score=score,
        ),
    )
    return rows.select("org", *_RECORD, F.explode(drafts).alias("d")).select("org", *_RECORD, "d.*")


def period_text(start: Column, end: Column) -> Column:
    """Reporting period in the wording that evidence keys are made of."""
    return F.concat(F.lit("{'fraDato': '"), start, F.lit("', 'tilDato': '"), end, F.lit("'}"))


def period_json(start: Column, end: Column) -> Column:
    return F.concat(F.lit('{"fraDato":"'), start, F.lit('","tilDato":"'), end, F.lit('"}'))


def _financial_drafts(modules: DataFrame, financials: DataFrame) -> DataFrame:
    rows = modules.filter(F.col("module") == "financials").select("org", *_RECORD)
    state = availability(F.col("status"))
    records = financials.select(
        "org", F.col("position").alias("_position"), "period_start", "period_end", F.col("currency").alias("_currency"),
        *FINANCIAL_FIELDS,
    )
    joined = rows.join(records, "org", "left")
    period = period_text(F.col("period_start"), F.col("period_end"))
    present = (state == "available") & F.col("_position").isNotNull()
    drafts = []
    for index, field in enumerate(FINANCIAL_FIELDS):
        amount = F.col(field)
        span = F.concat(
            F.lit("period="), period, F.lit("; currency="), F.coalesce("_currency", F.lit("None")),
            F.lit(f"; {field}="), amount.cast("string"),
        )
        order = F.concat(F.lit("30|"), F.lpad((F.col("_position") * 10 + index).cast("string"), 6, "0"))
        drafts.append(
            _draft(
                # The JSON of a whole number is its text.
                f"financial.{field}", amount.cast("string"), F.when(present & amount.isNotNull(), F.lit("available")), span,
                F.concat(F.lit("financials:"), period), order,
                currency=F.col("_currency"), reporting_period=period_json(F.col("period_start"), F.col("period_end")),
            )
        )
    unavailable = F.when(state != "available", state).when(F.col("_position").isNull(), F.lit("not_available"))
    empty_span = F.when(
        state == "available", F.lit("The accounts register answered without a record.")
    )
    drafts.append(_draft("financials", F.lit(None).cast("string"), unavailable, empty_span, "financials", "30|000000"))
    return joined.select("org", *_RECORD, F.explode(F.array(*drafts)).alias("d")).select("org", *_RECORD, "d.*")


def _module_drafts(modules: DataFrame) -> DataFrame:
    rows = modules.filter(F.col("module").isin(*STRUCTURED_MODULES))
    position, field = F.lit(0), F.lit(None).cast("string")
    for index, (module, name) in enumerate(STRUCTURED_MODULES.items()):
        position = F.when(F.col("module") == module, F.lit(index)).otherwise(position)
        field = F.when(F.col("module") == module, F.lit(name)).otherwise(field)
    draft = _draft(
        field, F.col("value"), availability(F.col("status")), F.lit(None).cast("string"), F.col("module"),
        F.concat(F.lit("40|"), F.lpad(position.cast("string"), 6, "0")),
    )
    return rows.select("org", *_RECORD, draft.alias("d")).select("org", *_RECORD, "d.*")


def base_drafts(entities: DataFrame, modules: DataFrame, financials: DataFrame) -> DataFrame:
    """Drafts of the registry, website, financial and module claims of every company."""
    return union_all(
        _registry_drafts(entities, modules),
        _website_drafts(modules),
        _financial_drafts(modules, financials),
        _module_drafts(modules),
    )


def base_claims(entities: DataFrame, modules: DataFrame, financials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry, website, financial and module claims of every company with their evidence."""
    return split_drafts(base_drafts(entities, modules, financials))


def module_errors(modules: DataFrame) -> DataFrame:
    """Modules that failed, were blocked or were never fetched."""
    return modules.filter(F.col("status").isin("source_error", "blocked", "not_fetched")).select(
        "org", "module", "status", F.col("note").alias("message"), "source_url"
    )


def obligation_modules(entities: DataFrame, source_url: str, as_of: str, ruleset: str) -> DataFrame:
    """Accounting-obligation module of every entity from the rule path."""
    value = json_object(
        {
            "classification": json_value(accounting_obligation(F.col("legal_form"), F.col("latest_submitted_accounts"))),
            "legal_form": json_value(F.nullif(F.upper("legal_form"), F.lit(""))),
            "latest_submitted_accounts": json_value(F.nullif(F.col("latest_submitted_accounts"), F.lit(""))),
            "ruleset_version": json_value(F.lit(ruleset)),
        }
    )
    return entities.select(
        "org",
        F.lit("accounting_obligation").alias("module"),
        F.lit("available").alias("status"),
        F.lit("official_rule_interpretation").alias("source_type"),
        F.lit(source_url).alias("source_url"),
        value.alias("value"),
        F.lit(as_of).alias("as_of"),
        F.sha2(F.lit(ruleset), 256).alias("content_sha256"),
        F.col("org").alias("source_row_key"),
    )


# --- P2, P3, P4: live registry -----------------------------------------------------------------

def live_records(modules: DataFrame) -> DataFrame:
    """Usable live registry records: available, with address, time and a full hash."""
    return modules.filter(
        (F.col("module") == "registry_live")
        & (F.col("status") == "available")
        & (F.trim(F.coalesce("source_url", F.lit(""))) != "")
        & (F.trim(F.coalesce("retrieved_at", F.lit(""))) != "")
        & (F.length(F.coalesce("content_sha256", F.lit(""))) == 64)
    )


def _code_and_description(value: Column, base: str) -> Column:
    def either(*names: str) -> Column:
        return F.coalesce(*[variant_member(value, f"{base}.{name}") for name in names])

    null = F.lit("null")

    def both(code: Column, description: Column) -> Column:
        pair = F.concat(
            F.lit('{"code":'), F.coalesce(code, null), F.lit(',"description":'), F.coalesce(description, null), F.lit("}")
        )
        return F.when(code.isNotNull() | description.isNotNull(), pair)

    found = F.struct(either("kode", "code").alias("code"), either("beskrivelse", "description").alias("description"))
    return bound(found, lambda pair: both(pair["code"], pair["description"]))


def live_values(value: Column) -> dict[str, Column]:
    """JSON value per live field of a parsed (variant) record; null where the exact live response holds nothing."""

    def flag(name: str) -> Column:
        return bound(variant_member(value, f"$.{name}"), lambda raw: F.when(raw.isin("true", "false"), raw))

    def text(name: str) -> Column:
        return bound(variant_text(value, f"$.{name}"), json_value)

    def group(base: str, keys: tuple[str, ...]) -> Column:
        return json_object({key: variant_member(value, f"{base}.{key}") for key in keys})

    return {
        "industry": _code_and_description(value, "$.industry"),
        "municipality_number": text("business_address.kommunenummer"),
        "bankrupt": flag("bankrupt"),
        "liquidating": flag("liquidating"),
        "forced_dissolution": flag("forced_dissolution"),
        "registration_date": text("registration_date"),
        "foundation_date": text("foundation_date"),
        "articles_date": text("articles_date"),
        "registered_in_enterprise_register": flag("registered_in_enterprise_register"),
        "enterprise_register_date": text("enterprise_register_date"),
        "institutional_sector": _code_and_description(value, "$.institutional_sector"),
        "registered_capital": group("$.registered_capital", _CAPITAL_KEYS),
        "registered_in_vat_register": flag("registered_in_vat_register"),
        "vat_registration_date": text("vat_registration_date"),
        "registered_address": group("$.business_address", _ADDRESS_KEYS),
        "postal_address": group("$.postal_address", _ADDRESS_KEYS),
        "registered_contact_email": text("contact_email"),
        "registered_phone": text("contact_phone"),
        "registered_mobile": text("contact_mobile"),
    }


def live_registry_claims(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nineteen claims per live record, each available or explicitly not available; nothing falls back to bulk data."""
    return split_live(settled_live(modules))


def split_live(settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and evidence of :func:`settled_live`."""
    return settled.select(*CLAIM.fieldNames()), conform(settled.select("org", "backing.*"), EVIDENCE)


def settled_live(modules: DataFrame) -> DataFrame:
    """The claims of :func:`live_registry_claims`, each with its evidence row in a struct ``backing``."""
    values = live_values(F.col("_parsed"))
    cells = F.array(
        *[
            F.struct(
                F.lit(f"50|{position:06d}").alias("claim_order"),
                F.lit(field).alias("field"),
                F.lit(LIVE_SOURCE_PATHS[field]).alias("path"),
                values[field].alias("value"),
            )
            for position, field in enumerate(LIVE_SOURCE_PATHS)
        ]
    )
    rows = (
        live_records(modules)
        .withColumn("_parsed", F.try_parse_json("value"))
        .select("org", "source_url", "retrieved_at", "content_sha256", F.explode(cells).alias("cell"))
        .select("org", "source_url", "retrieved_at", "content_sha256", "cell.*")
        .withColumn(
            "id",
            material_id(
                "ev-c12-registry-live-", 20, F.col("org"), F.lit("c12-registry-live"), F.col("field"), F.col("path"),
                F.col("source_url"), F.col("content_sha256"),
            ),
        )
    )
    state = F.when(F.col("value").isNotNull(), F.lit("available")).otherwise(F.lit("not_available"))
    scope = F.concat(
        F.lit("Exact organisation-number live registry response; value must resolve from "), F.col("path"),
        F.lit(". Bulk fallback is prohibited."),
    )
    span = F.when(
        F.col("value").isNotNull(), F.concat(F.col("path"), F.lit("="), F.col("value"))
    ).otherwise(F.concat(F.col("path"), F.lit(" absent from the stored answer")))
    backing = F.struct(
        "id", "source_url", F.lit("official").alias("source_class"), "retrieved_at", "content_sha256",
        F.col("org").alias("source_row_key"), F.col("path").alias("source_field"), span.alias("claim_span"),
    )
    claims = rows.select(
        "org", "claim_order", "field", "value", state.alias("availability"), F.lit(1.0).alias("confidence"),
        F.array("id").alias("evidence_ids"), F.lit(LIVE_SIGNAL).alias("signal_type"), scope.alias("claim_scope"), backing.alias("backing"),
    )
    return conform(claims, T.StructType([*CLAIM.fields, claims.schema["backing"]]))


def owns_live_claim() -> Column:
    return F.col("field").isin(*LIVE_SOURCE_PATHS) & F.col("signal_type").isin(LIVE_SIGNAL, OLD_LIVE_SIGNAL)


def _narrative_text(value: Column, name: str) -> Column:
    """Literal narrative: a list of lines is joined with blanks."""

    def joined(raw: Column) -> Column:
        lines = F.filter(F.from_json(raw, "array<string>"), lambda line: F.trim(line) != "")
        return F.when(F.startswith(raw, F.lit("[")), F.array_join(lines, " ")).otherwise(F.get_json_object(value, f"$.{name}"))

    return unless(squash(bound(json_member(value, f"$.{name}"), joined)), "")


def narrative_claims(claims: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registered purpose always; registered activity as description only where no other description is available."""
    described = claims.filter(
        (F.col("field") == "company_description")
        & (F.col("availability") == "available")
        & (F.trim(F.coalesce(json_text(F.col("value")), F.lit(""))) != "")
        & (F.coalesce("signal_type", F.lit("")) != NARRATIVE_SIGNAL)
    ).select("org").distinct().withColumn("_described", F.lit(True))
    value = F.col("value")
    cells = F.array(
        F.struct(
            F.lit("55|000000").alias("claim_order"), F.lit("company_description").alias("field"),
            F.lit("aktivitet").alias("key"),
            F.when(F.col("_described").isNull(), _narrative_text(value, "activity")).alias("text"),
        ),
        F.struct(
            F.lit("55|000001").alias("claim_order"), F.lit("registered_purpose").alias("field"),
            F.lit("vedtektsfestetFormaal").alias("key"), _narrative_text(value, "registered_purpose").alias("text"),
        ),
    )
    rows = (
        live_records(modules)
        .join(described, "org", "left")
        .select("org", "source_url", "retrieved_at", "content_sha256", F.explode(cells).alias("cell"))
        .select("org", "source_url", "retrieved_at", "content_sha256", "cell.*")
        .filter(F.col("text").isNotNull())
        .withColumn(
            "id",
            material_id(
                "ev-c12-registry-narrative-", 20, F.col("org"), F.lit("c12-registry-narrative-live"), F.col("field"),
                F.col("source_url"), F.col("content_sha256"), F.col("text"),
            ),
        )
    )
    new_claims = rows.select(
        "org", "claim_order", "field", json_value(F.col("text")).alias("value"), F.lit("available").alias("availability"),
        F.lit(1.0).alias("confidence"), F.array("id").alias("evidence_ids"), F.lit(NARRATIVE_SIGNAL).alias("signal_type"),
        F.lit(
            "Literal value retained from the exact organisation-number live registry response; bulk fallback is prohibited."
        ).alias("claim_scope"),
    )
    evidence = rows.select(
        "org", "id", "source_url", F.lit("official").alias("source_class"), "retrieved_at", "content_sha256",
        F.col("org").alias("source_row_key"), F.concat(F.lit("/"), F.col("key")).alias("source_field"),
        F.concat(F.lit("/"), F.col("key"), F.lit("="), F.col("text")).alias("claim_span"),
    )
    return conform(new_claims, CLAIM), conform(evidence, EVIDENCE)


def owns_narrative_claim() -> Column:
    return F.col("field").isin("company_description", "registered_purpose") & (F.col("signal_type") == NARRATIVE_SIGNAL)


def registry_workforce(modules: DataFrame) -> DataFrame:
    """Workforce observation per live record that reports an employee count of 0 to 1,000,000."""
    count = F.get_json_object("value", "$.employees").try_cast("int")
    rows = (
        live_records(modules)
        .filter(F.col("org").rlike(r"^[0-9]{9}$") & F.col("source_url").rlike(r"^https?://"))
        .withColumn("count", count)
        .filter(F.col("count").between(0, 1_000_000))
    )
    number = F.col("count").cast("string")
    proof = F.array(
        F.create_map(
            F.lit("type"), F.lit("official_registry_exact_organisation_number"), F.lit("organisation_number"), F.col("org")
        ),
        F.create_map(F.lit("type"), F.lit("official_registry_employee_count"), F.lit("employees"), number),
    )
    metrics = F.create_map(
        F.lit("workforce_value"), number, F.lit("employees"), number, F.lit("measure"), F.lit("employees"),
        F.lit("scope"), F.lit("registry_entity"),
    )
    observations = rows.select(
        material_id(
            "brreg-workforce-", 24, F.col("org"), F.col("count"), F.col("source_url"), F.col("content_sha256")
        ).alias("id"),
        "org",
        F.lit("brreg").alias("platform"),
        F.lit("workforce_snapshot").alias("signal_type"),
        "source_url",
        "retrieved_at",
        "content_sha256",
        F.lit(True).alias("exact_entity"),
        proof.alias("identity_proof"),
        F.lit("official_api").alias("acquisition_mode"),
        F.lit("approved").alias("rights_status"),
        F.lit("official_registry_live").alias("source_class"),
        F.concat(
            F.lit("Entity register: employees="), number, F.lit(", company "), F.col("org"), F.lit(".")
        ).alias("evidence_span"),
        F.col("retrieved_at").alias("effective_at"),
        metrics.alias("metrics"),
        F.lit("official_registry_employee_count_v1").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


# --- F5, F8: validation ------------------------------------------------------------------------

def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def failed_rules(rows: DataFrame, *rules: tuple[Column, str, Column]) -> DataFrame:
    """(org, rule, subject) for every rule that a row breaks: one scan, whatever the number of rules."""
    broken = [F.when(condition, F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))) for condition, rule, subject in rules]
    return rows.select("org", F.inline(F.array_compact(F.array(*broken))))


def contract_violations(runs: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """All contract breaches as (org, rule, subject); every table is read once for its own rules.

    ``runs`` has one row per company: org, run_id, started_at, completed_at, terminal_status, requests, cost_usd.
    """
    org, item, field = F.col("org"), F.col("id"), F.col("field")
    of_runs = failed_rules(
        runs,
        (~F.coalesce(org.rlike(r"^[0-9]{9}$"), F.lit(False)), "invalid organisation number", org),
        *[(_blank(name), f"missing run.{name}", org) for name in ("run_id", "started_at", "completed_at", "terminal_status")],
        (F.coalesce("requests", F.lit(0)) < 0, "operations.requests is negative", org),
        (F.coalesce("cost_usd", F.lit(0.0)) < 0, "operations.third_party_cost_usd is negative", org),
    )
    counted = evidence.groupBy("org", "id").agg(F.count(F.lit(1)).alias("_n"))
    of_ids = failed_rules(counted, (_blank("id") | (F.col("_n") > 1), "duplicate or missing evidence ids", F.coalesce("id", F.lit(""))))
    of_evidence = failed_rules(
        evidence, *[(~_blank("id") & _blank(name), f"evidence missing {name}", item) for name in ("source_url", "retrieved_at", "claim_span")]
    )
    state = F.coalesce("availability", F.lit(""))
    of_claims = failed_rules(
        claims,
        (~state.isin(*ALLOWED_AVAILABILITY), "claim has invalid availability", field),
        ((state != "available") & F.col("value").isNotNull(), "claim has value while unavailable", field),
        ((state == "available") & (F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1), "claim lacks evidence ids", field),
    )
    refs = claims.select("org", "field", F.explode("evidence_ids").alias("id"))
    dangling = refs.join(counted.filter(~_blank("id")).select("org", "id"), ["org", "id"], "left_anti")
    of_refs = dangling.select("org", F.lit("claim references missing evidence").alias("rule"), F.concat_ws(":", "field", "id").alias("subject"))
    return reduce(DataFrame.unionByName, [of_runs, of_ids, of_evidence, of_claims, of_refs])


TERMINAL_STATES = (
    "complete", "not_applicable", "not_found", "blocked_policy", "blocked_robots", "source_error", "budget_exhausted",
    "submission_error",
)


def module_terminal_state(status: Column, note: Column) -> Column:
    robots = F.contains(F.lower(F.coalesce(note, F.lit(""))), F.lit("robot"))
    return (
        F.when(status == "available", F.lit("complete"))
        .when(status.isin("not_applicable", "not_found", "source_error"), status)
        .when(status == "blocked", F.when(robots, F.lit("blocked_robots")).otherwise(F.lit("blocked_policy")))
        .otherwise(F.lit("submission_error"))
    )


def terminal_envelopes(orgs: DataFrame, modules: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """Terminal state per company and wanted module; a missing record is a submission error.

    ``org_state`` is a submission error as soon as one module is.
    """
    grid = orgs.select("org", F.explode(F.array(*[F.lit(name) for name in wanted])).alias("module"))
    states = grid.join(modules.select("org", "module", "status", "note"), ["org", "module"], "left").select(
        "org", "module", module_terminal_state(F.col("status"), F.col("note")).alias("state")
    )
    return states


def entity_states(envelopes: DataFrame) -> DataFrame:
    failed = F.bool_or(F.col("state") == "submission_error")
    return envelopes.groupBy("org").agg(F.when(failed, F.lit("submission_error")).otherwise(F.lit("complete")).alias("state"))


def envelope_checks(orgs: DataFrame, envelopes: DataFrame, expected: int) -> DataFrame:
    """One row of batch checks: expected count, unique numbers, terminal states, no silent drops."""
    delivered = orgs.agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("org").alias("_orgs"))
    terminal = envelopes.agg(F.bool_and(F.col("state").isin(*TERMINAL_STATES)).alias("all_module_states_terminal"))
    # Two one-row tables.
    exact, unique = F.col("_rows") == expected, F.col("_rows") == F.col("_orgs")
    return delivered.join(F.broadcast(terminal), F.lit(True)).select(
        exact.alias("exact_expected_count"),
        unique.alias("unique_organisation_numbers"),
        F.coalesce("all_module_states_terminal", F.lit(True)).alias("all_module_states_terminal"),
        (exact & unique).alias("zero_silent_drops"),
    )


def first_claims(claims: DataFrame) -> DataFrame:
    """First claim per company and field in claim order, combined on the map side."""
    rest = [name for name in claims.columns if name not in ("org", "field")]
    return (
        claims.groupBy("org", "field")
        .agg(F.min_by(F.struct(*rest), F.col("claim_order")).alias("_row"))
        .select("org", "field", "_row.*")
    )


