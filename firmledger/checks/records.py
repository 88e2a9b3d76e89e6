"""Official responses, module evidence and accounts derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MODULE_EVIDENCE, conform, union_all
from ..operators.claims import obligation_modules
from ..sources import official
from . import bindings as b
from .stored import spread, stored

BULK_SHA = "a" * 64
RULESET = "accounting_rules_v1"
RULES_URL = "https://rules.example/"


def key() -> F.Column:
    return F.col("org").cast("bigint") - b.ORG_BASE


def http_status() -> F.Column:
    digit = F.pmod(key(), F.lit(10))
    return F.when(digit == 5, F.lit(404)).when(digit == 7, F.lit(503)).otherwise(F.lit(200))


LIVE_OK_SQL = "k % 10 NOT IN (5, 7)"


def financials(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    return stored(spark, d, "financials" if before is None else "financials-old", lambda: _financials(spark, d, before))


def _financials(spark: SparkSession, d: str, before: str | None) -> DataFrame:
    """All yearly accounts per company, newest first."""
    newest = Window.partitionBy("org").orderBy(F.col("period_end").desc())
    return b.accounts(spark, d, before).withColumn("position", F.row_number().over(newest) - 1)


def financials_sql(name: str = "fin", accounts: str = "accounts") -> str:
    return f"""{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY org ORDER BY period_end DESC) - 1 AS INTEGER) AS position FROM {accounts}
)"""


def live_body() -> F.Column:
    """Registry payload of a company in the source's own member names."""
    address = F.struct(
        F.array(F.concat(F.lit("Gata "), key().cast("string"))).alias("adresse"),
        F.col("municipality").alias("kommune"),
        F.col("municipality_number").alias("kommunenummer"),
        F.lit("").alias("postnummer"),
    )
    return F.to_json(
        F.struct(
            F.col("org").alias("organisasjonsnummer"),
            F.col("name").alias("navn"),
            F.struct(F.col("legal_form").alias("kode")).alias("organisasjonsform"),
            F.col("employees").alias("antallAnsatte"),
            F.col("bankrupt").alias("konkurs"),
            F.col("website").alias("hjemmeside"),
            F.struct(F.col("industry_code").alias("kode"), F.col("industry_label").alias("beskrivelse")).alias("naeringskode1"),
            address.alias("forretningsadresse"),
            F.col("latest_submitted_accounts").alias("sisteInnsendteAarsregnskap"),
            F.when(F.pmod(key(), F.lit(2)) == 0, F.array(F.lit("Handel  med"), F.col("industry_label"))).alias("aktivitet"),
            F.when(F.pmod(key(), F.lit(3)) == 0, F.lit("Å drive handel")).alias("vedtektsfestetFormaal"),
            F.when(F.pmod(key(), F.lit(4)) == 0, F.concat(F.lit("post@kunde"), key().cast("string"), F.lit(".example.no"))).alias(
                "epostadresse"
            ),
        )
    )


def roles_body() -> F.Column:
    number = key().cast("string")
    even, third = F.pmod(key(), F.lit(2)) == 0, F.pmod(key(), F.lit(3)) == 0

    def person(first: str) -> F.Column:
        return F.struct(F.struct(F.lit(first).alias("fornavn"), F.concat(F.lit("Nordmann "), number).alias("etternavn")).alias("navn"))

    def role(code: str, text: str, who: F.Column, inactive: F.Column) -> F.Column:
        no_person = F.lit(None).cast("struct<navn:struct<fornavn:string,etternavn:string>>")
        no_unit = F.lit(None).cast("struct<navn:string,organisasjonsnummer:string>")
        unit = F.struct(F.concat(F.lit("Revisor "), number).alias("navn"), F.lit("899999999").alias("organisasjonsnummer"))
        return F.struct(
            F.struct(F.lit(code).alias("kode"), F.lit(text).alias("beskrivelse")).alias("type"),
            (who if who is not None else no_person).alias("person"),
            (no_unit if who is not None else unit).alias("enhet"),
            inactive.alias("avregistrert"),
        )

    board = F.struct(
        F.lit("2024-01-01").alias("sistEndret"),
        F.struct(F.lit("STYR").alias("kode"), F.lit("Styre").alias("beskrivelse")).alias("type"),
        F.array(role("LEDE", "Styrets leder", person("Ola"), F.lit(False)), role("REVI", "Revisor", None, third)).alias("roller"),
    )
    manager = F.struct(
        F.lit("2024-01-02").alias("sistEndret"),
        F.struct(F.lit("DAGL").alias("kode"), F.lit("Daglig leder").alias("beskrivelse")).alias("type"),
        F.array(role("DAGL", "Daglig leder", person("Kari"), F.lit(False))).alias("roller"),
    )
    groups = F.when(even, F.array(board, manager)).otherwise(F.array(board))
    return F.to_json(F.struct(groups.alias("rollegrupper")))


def locations_body() -> F.Column:
    items = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= F.pmod(key(), F.lit(4))),
        lambda i: F.struct(
            F.concat(F.lit("97"), F.lpad((key() * 10 + i).cast("string"), 7, "0")).alias("organisasjonsnummer"),
            F.concat(F.lit("Avdeling "), i.cast("string")).alias("navn"),
            F.when(i == 2, F.struct(F.lit("Postboks 2").alias("poststed"))).alias("postadresse"),
            F.when(i != 2, F.struct(F.col("municipality").alias("poststed"))).alias("beliggenhetsadresse"),
            i.cast("int").alias("antallAnsatte"),
        ),
    )
    return F.to_json(F.struct(F.struct(items.alias("underenheter")).alias("_embedded")))


def accounts_body(spark: SparkSession, d: str) -> DataFrame:
    """All yearly accounts of a company as one payload, newest first. A customer has a handful of years."""
    record = F.struct(
        F.concat("org", F.lit("-"), F.substring("period_end", 1, 4)).alias("id"),
        F.lit("SELSKAP").alias("regnskapstype"),
        F.struct(F.col("period_start").alias("fraDato"), F.col("period_end").alias("tilDato")).alias("regnskapsperiode"),
        F.col("currency").alias("valuta"),
        F.struct(
            F.struct(
                F.struct(F.col("revenue").alias("sumDriftsinntekter")).alias("driftsinntekter"),
                F.col("operating_result").alias("driftsresultat"),
            ).alias("driftsresultat"),
            F.col("annual_result").alias("aarsresultat"),
        ).alias("resultatregnskapResultat"),
        F.struct(F.col("assets").alias("sumEiendeler")).alias("eiendeler"),
        F.struct(F.struct(F.col("debt").alias("sumGjeld")).alias("gjeldOversikt")).alias("egenkapitalGjeld"),
    )
    year = F.substring("period_end", 1, 4)
    listed = b.accounts(spark, d).groupBy("org").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("period_end").alias("k"), record.alias("r"))))).alias("rows"),
        F.to_json(F.collect_list(year)).alias("years"),
    )
    return listed.select("org", F.to_json(F.transform("rows", lambda row: row["r"])).alias("records"), "years")


RESPONSE_MODULES = ("registry_live", "roles", "locations", "financials", "financial_history")
MODULES = ("registry", "website", *RESPONSE_MODULES, "accounting_obligation")


def responses(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Responses table of the named modules, or of all; each module is a stored table of its own, made when it is first read."""
    return union_all(*[stored(spark, d, f"responses-{name}", lambda name=name: _responses(spark, d, name)) for name in names or RESPONSE_MODULES])


def _responses(spark: SparkSession, d: str, module: str) -> DataFrame:
    """Responses of one module."""
    rows = accounts_body(spark, d) if module.startswith("financial") else b.entity(spark, d)
    status = http_status() if module == "registry_live" else F.lit(200)
    body = {
        "registry_live": live_body, "roles": roles_body, "locations": locations_body, "financials": lambda: F.col("records"),
        "financial_history": lambda: F.col("years"),
    }[module]()
    return _answers(rows, module, status, F.when(status == 200, body))


def _answers(rows: DataFrame, module: str, status: F.Column, body: F.Column) -> DataFrame:
    return rows.select(
        "org",
        F.lit(module).alias("module"),
        F.concat(F.lit(f"{b.REGISTRY_URL}{module}/"), F.col("org")).alias("url"),
        status.alias("status"),
        body.alias("body"),
        F.sha2(F.concat(F.lit(f"{module}|"), F.col("org")), 256).alias("content_sha256"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.lit("2024-01-31").alias("effective_at"),
        F.lit(None).cast("string").alias("error"),
    )


def account_states(spark: SparkSession, d: str) -> DataFrame:
    """Module evidence of the accounts without the answers' bodies, for readers that take the records from :func:`financials`."""
    rows = spread(financials(spark, d).filter(F.col("position") == 0).select("org"))
    return conform(official.module_evidence(_answers(rows, "financials", F.lit(200), F.lit(None).cast("string"))), MODULE_EVIDENCE)


def website_value() -> F.Column:
    publishable = F.pmod(key(), F.lit(2)) == 0
    return F.to_json(
        F.struct(
            F.concat(F.lit("https://"), F.col("website"), F.lit("/")).alias("final_url"),
            F.when(F.pmod(key(), F.lit(12)) == 0, F.concat(F.lit("Om "), F.col("name"))).alias("description"),
            F.struct(
                F.when(publishable, F.lit(0.95)).otherwise(F.lit(0.3)).alias("score"), publishable.alias("publishable"),
                F.lit("deterministic_name_org_evidence_v4").alias("method"),
            ).alias("identity_assessment"),
            F.when(
                F.pmod(key(), F.lit(18)) == 0,
                F.array(
                    F.struct(
                        F.lit("facebook").alias("platform"),
                        F.concat(F.lit("https://facebook.com/kunde"), key().cast("string")).alias("url"),
                    )
                ),
            ).alias("social_links"),
        )
    )


def modules(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Module evidence of the named modules, or of all: bulk registry, live registry, accounts, roles, locations, website and obligation."""
    return union_all(*[_module(spark, d, name) for name in names or MODULES])


def module_states(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Module evidence for readers of states: no answer is stored or normalised for it, and what is not read is not made."""
    made = [_module(spark, d, name) for name in names if name not in RESPONSE_MODULES]
    answers = [_responses(spark, d, name) for name in names if name in RESPONSE_MODULES]
    if answers:
        made.append(conform(official.module_evidence(union_all(*answers)), MODULE_EVIDENCE))
    return union_all(*made)


def _module(spark: SparkSession, d: str, name: str) -> DataFrame:
    if name in ("registry_live", "roles", "locations"):
        return stored(spark, d, f"module-{name}", lambda: conform(_answered(spark, d, name), MODULE_EVIDENCE))
    rows = {
        "registry": _bulk, "website": _site, "accounting_obligation": lambda *_: obligation_modules(b.entity(spark, d), RULES_URL, "2024-08-09", RULESET)
    }
    return conform(rows[name](spark, d) if name in rows else _answered(spark, d, name), MODULE_EVIDENCE)


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    return b.entity(spark, d).select(
        "org", F.lit("registry").alias("module"), F.lit("available").alias("status"),
        F.lit("official_registry_bulk").alias("source_type"), F.lit(f"{b.REGISTRY_URL}bulk").alias("source_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"), F.lit(BULK_SHA).alias("content_sha256"), F.col("org").alias("source_row_key"),
    )


def _site(spark: SparkSession, d: str) -> DataFrame:
    return b.entity(spark, d).filter(F.col("website").isNotNull()).select(
        "org", F.lit("website").alias("module"), F.lit("available").alias("status"),
        F.lit("registry_linked_company_website").alias("source_type"),
        F.concat(F.lit("https://"), F.col("website"), F.lit("/")).alias("source_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"), website_value().alias("value"),
        F.sha2(F.concat(F.lit("website|"), F.col("org")), 256).alias("content_sha256"),
    )


def _answered(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Module evidence of one response module; roles and locations are stored in their normalised form."""
    raw = responses(spark, d, name)
    answered = official.module_evidence(raw)

    def listed(rows: DataFrame, member: str) -> DataFrame:
        # Few rows per company by construction of the payloads.
        return rows.groupBy("org").agg(
            F.concat(
                F.lit(f'{{"{member}":['),
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda r: r["value"]), ","),
                F.lit("]}"),
            ).alias("_value")
        )

    if name == "roles":
        normal = listed(official.role_module_values(official.roles(raw)), "roles")
    elif name == "locations":
        normal = listed(official.location_module_values(official.subunits(raw)), "locations")
    else:
        return answered
    return answered.join(normal, "org", "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")
