"""Official JSON payloads: entity, accounts, account years, roles, subunits, and their evidence status.

Input is a responses table (org, module, url, status, body, content_sha256, retrieved_at, effective_at, error).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import json_object, json_value, variant_member

_MONEY = "DECIMAL(38,2)"
ACCOUNTS_SCHEMA = (
    "ARRAY<STRUCT<id: STRING, regnskapstype: STRING, regnskapsperiode: STRUCT<fraDato: STRING, tilDato: STRING>, valuta: STRING,"
    f" resultatregnskapResultat: STRUCT<driftsresultat: STRUCT<driftsinntekter: STRUCT<sumDriftsinntekter: {_MONEY}>,"
    f" driftsresultat: {_MONEY}>, ordinaertResultatFoerSkattekostnad: {_MONEY}, aarsresultat: {_MONEY}>,"
    f" eiendeler: STRUCT<sumEiendeler: {_MONEY}>,"
    f" egenkapitalGjeld: STRUCT<egenkapital: STRUCT<sumEgenkapital: {_MONEY}>, gjeldOversikt: STRUCT<sumGjeld: {_MONEY}>>>>"
)
ROLES_SCHEMA = (
    "STRUCT<rollegrupper: ARRAY<STRUCT<sistEndret: STRING, type: STRUCT<kode: STRING, beskrivelse: STRING>,"
    " roller: ARRAY<STRUCT<type: STRUCT<kode: STRING, beskrivelse: STRING>,"
    " person: STRUCT<navn: STRUCT<fornavn: STRING, mellomnavn: STRING, etternavn: STRING>>,"
    " enhet: STRUCT<navn: STRING, organisasjonsnummer: STRING>, avregistrert: BOOLEAN>>>>>"
)
SUBUNITS_SCHEMA = (
    "STRUCT<_embedded: STRUCT<underenheter: ARRAY<STRUCT<organisasjonsnummer: STRING, navn: STRING, beliggenhetsadresse: STRING,"
    " postadresse: STRING, naeringskode1: STRING, antallAnsatte: INT>>>>"
)
# Entity fields and the payload members they come from.
ENTITY_MEMBERS = {
    "organisation_number": "organisasjonsnummer",
    "name": "navn",
    "legal_form": "organisasjonsform.kode",
    "employees": "antallAnsatte",
    "bankrupt": "konkurs",
    "liquidating": "underAvvikling",
    "forced_dissolution": "underTvangsavviklingEllerTvangsopplosning",
    "website": "hjemmeside",
    "industry": "naeringskode1",
    "business_address": "forretningsadresse",
    "postal_address": "postadresse",
    "latest_submitted_accounts": "sisteInnsendteAarsregnskap",
    "registration_date": "registreringsdatoEnhetsregisteret",
    "foundation_date": "stiftelsesdato",
    "articles_date": "vedtektsdato",
    "registered_in_enterprise_register": "registrertIForetaksregisteret",
    "enterprise_register_date": "registreringsdatoForetaksregisteret",
    "institutional_sector": "institusjonellSektorkode",
    "registered_capital": "kapital",
    "registered_in_vat_register": "registrertIMvaregisteret",
    "vat_registration_date": "registreringsdatoMerverdiavgiftsregisteret",
    "activity": "aktivitet",
    "registered_purpose": "vedtektsfestetFormaal",
    "contact_email": "epostadresse",
    "contact_phone": "telefon",
    "contact_mobile": "mobil",
}
# Module names and their source types.
MODULE_SOURCES = {
    "registry_live": "official_registry_live",
    "financials": "official_annual_accounts",
    "financial_history": "official_annual_account_copies",
    "roles": "official_roles",
    "group": "official_group_structure",
    "locations": "official_subunits",
}
ACCOUNT_COPY_URL = "https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/"


def entity_value(parsed: Column) -> Column:
    """Parsed (variant) entity payload as the normalised 26-field JSON value; missing members are null."""
    members = {
        name: F.coalesce(variant_member(parsed, f"$.{path}"), F.lit("null")) for name, path in ENTITY_MEMBERS.items()
    }
    return json_object(members)


def financial_records(responses: DataFrame) -> DataFrame:
    """All account records of each payload in payload order; a missing amount stays null, never zero."""
    rows = responses.filter((F.col("module") == "financials") & (F.col("status") == 200))
    parsed = rows.select("org", F.posexplode(F.from_json("body", ACCOUNTS_SCHEMA)).alias("position", "r"))
    result = F.col("r.resultatregnskapResultat")
    return parsed.select(
        "org",
        "position",
        F.col("r.id").alias("record_id"),
        F.col("r.regnskapstype").alias("account_type"),
        F.col("r.regnskapsperiode.fraDato").alias("period_start"),
        F.col("r.regnskapsperiode.tilDato").alias("period_end"),
        F.col("r.valuta").alias("currency"),
        result["driftsresultat"]["driftsinntekter"]["sumDriftsinntekter"].alias("revenue"),
        result["driftsresultat"]["driftsresultat"].alias("operating_result"),
        result["ordinaertResultatFoerSkattekostnad"].alias("profit_before_tax"),
        result["aarsresultat"].alias("annual_result"),
        F.col("r.eiendeler.sumEiendeler").alias("assets"),
        F.col("r.egenkapitalGjeld.egenkapital.sumEgenkapital").alias("equity"),
        F.col("r.egenkapitalGjeld.gjeldOversikt.sumGjeld").alias("debt"),
    )


def account_years(body: Column) -> Column:
    """Sorted distinct numeric years of an account-year payload."""
    years = F.from_json(body, "array<string>")
    numeric = F.filter(F.coalesce(years, F.array().cast("array<string>")), lambda year: year.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(numeric))


def account_copies(responses: DataFrame) -> DataFrame:
    """(org, year, url) of every annual-account copy, newest first inside a company."""
    rows = responses.filter((F.col("module") == "financial_history") & (F.col("status") == 200))
    listed = rows.select("org", F.posexplode(F.reverse(account_years(F.col("body")))).alias("position", "year"))
    return listed.select(
        "org", "position", "year", F.concat(F.lit(ACCOUNT_COPY_URL), F.col("org"), F.lit("/"), F.col("year")).alias("url")
    )


def roles(responses: DataFrame) -> DataFrame:
    """One row per role in payload order: person or entity name, no birth dates, with the inactive flag."""
    rows = responses.filter((F.col("module") == "roles") & (F.col("status") == 200))
    groups = rows.select("org", F.posexplode(F.from_json("body", ROLES_SCHEMA)["rollegrupper"]).alias("_g", "g"))
    items = groups.select("org", "_g", "g", F.posexplode("g.roller").alias("_r", "r"))
    person = F.concat_ws(
        " ",
        *[F.nullif(F.col(f"r.person.navn.{part}"), F.lit("")) for part in ("fornavn", "mellomnavn", "etternavn")],
    )
    return items.select(
        "org",
        (F.col("_g") * 100_000 + F.col("_r")).alias("position"),
        F.coalesce(F.nullif(person, F.lit("")), F.nullif(F.col("r.enhet.navn"), F.lit(""))).alias("name"),
        F.col("r.enhet.organisasjonsnummer").alias("organisation_number"),
        F.col("r.type.kode").alias("role_code"),
        F.col("r.type.beskrivelse").alias("role"),
        F.col("g.type.kode").alias("group_code"),
        F.col("g.type.beskrivelse").alias("group_name"),
        F.col("g.sistEndret").alias("last_changed"),
        F.coalesce("r.avregistrert", F.lit(False)).alias("inactive"),
    )


def subunits(responses: DataFrame) -> DataFrame:
    """One row per subunit; the location address falls back to the postal one."""
    rows = responses.filter((F.col("module") == "locations") & (F.col("status") == 200))
    items = rows.select(
        "org", F.posexplode(F.from_json("body", SUBUNITS_SCHEMA)["_embedded"]["underenheter"]).alias("position", "u")
    )
    return items.select(
        "org",
        "position",
        F.col("u.organisasjonsnummer").alias("organisation_number"),
        F.col("u.navn").alias("name"),
        F.coalesce("u.beliggenhetsadresse", "u.postadresse").alias("address"),
        F.col("u.naeringskode1").alias("industry"),
        F.col("u.antallAnsatte").alias("employees"),
    )


def response_status(http_status: Column) -> Column:
    """Evidence status of an HTTP status: 200 found, 404 and 410 not found, the rest an error."""
    return (
        F.when(http_status == 200, F.lit("available"))
        .when(http_status.isin(404, 410), F.lit("not_found"))
        .otherwise(F.lit("source_error"))
    )


def module_evidence(responses: DataFrame) -> DataFrame:
    """Module evidence of a responses table; entity payloads are normalised, the other bodies kept as they are."""
    source_type = F.lit(None).cast("string")
    for module, name in MODULE_SOURCES.items():
        source_type = F.when(F.col("module") == module, F.lit(name)).otherwise(source_type)
    status = response_status(F.col("status"))
    live = F.col("module") == "registry_live"
    value = F.when(live, entity_value(F.col("_parsed"))).otherwise(F.col("body"))
    return responses.withColumn("_parsed", F.when(live, F.try_parse_json("body"))).select(
        "org",
        "module",
        status.alias("status"),
        source_type.alias("source_type"),
        F.col("url").alias("source_url"),
        "retrieved_at",
        F.when(status == "available", value).alias("value"),
        F.lit(None).cast("string").alias("as_of"),
        F.when(status != "available", F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")))).alias("note"),
        "content_sha256",
        F.lit(None).cast("string").alias("source_row_key"),
        "effective_at",
    )


def role_module_values(role_rows: DataFrame) -> DataFrame:
    """Roles as one row per company and role with its JSON value, ready for fact projection."""
    value = F.to_json(
        F.struct(
            "group_code", F.col("group_name").alias("group"), "inactive", "last_changed", "name", "organisation_number",
            "role", "role_code",
        ),
        {"ignoreNullFields": "false"},
    )
    return role_rows.select("org", "position", "inactive", "name", "role", "role_code", value.alias("value"))


def location_module_values(subunit_rows: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("address"), F.lit("null"))
    value = F.concat(
        F.lit('{"address":'), raw, F.lit(',"name":'), F.coalesce(json_value(F.col("name")), F.lit("null")),
        F.lit(',"organisation_number":'), F.coalesce(json_value(F.col("organisation_number")), F.lit("null")), F.lit("}"),
    )
    return subunit_rows.select("org", "position", value.alias("value"))
