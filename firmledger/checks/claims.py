"""Official payload, claim, fact and refresh checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import json_text
from ..model import CLAIM, EVIDENCE, MODULE_EVIDENCE, conform, union_all
from ..operators import canonical as can
from ..operators import claims as c
from ..operators import refresh as rf
from ..operators.audits import table_difference
from ..operators.awards import AWARD_FIELD, award_claims
from ..operators.changes import CHANGE_FIELD, change_claims
from ..sources import official, snapshots
from . import bindings as b
from . import records as rec
from .awards import selected_awards
from .changes import selected_changes
from .registry import check
from .stored import spread, stored

_BASE = (b.ENTITY_SQL, b.ACCOUNTS_SQL, rec.financials_sql())


def _sha(*parts: str) -> str:
    return "sha256(concat(" + ", '|', ".join(parts) + "))"


# --- official payloads -------------------------------------------------------------------------

@check(
    "S7_live_entity",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, name, legal_form, CAST(employees AS VARCHAR) AS employees, CAST(bankrupt AS VARCHAR) AS bankrupt,
          website, industry_code, municipality_number, CASE WHEN k % 4 = 0 THEN concat('post@kunde', k, '.example.no') END AS contact_email
          FROM entity WHERE {rec.LIVE_OK_SQL}""",
    ),
)
def live_entity(spark: SparkSession, d: str) -> DataFrame:
    rows = official.module_evidence(rec.responses(spark, d, "registry_live")).filter(
        (F.col("module") == "registry_live") & (F.col("status") == "available")
    )

    def member(path: str):
        return F.get_json_object("value", f"$.{path}")

    return rows.select(
        "org", member("name").alias("name"), member("legal_form").alias("legal_form"), member("employees").alias("employees"),
        member("bankrupt").alias("bankrupt"), member("website").alias("website"),
        member("industry.kode").alias("industry_code"),
        member("business_address.kommunenummer").alias("municipality_number"), member("contact_email").alias("contact_email"),
    )


@check(
    "S8_account_records",
    sql=b.with_ctes(
        *_BASE,
        """SELECT org, position, period_start, period_end, currency, revenue, operating_result, annual_result, assets, equity, debt FROM fin""",
    ),
)
def account_records(spark: SparkSession, d: str) -> DataFrame:
    rows = official.financial_records(rec.responses(spark, d, "financials"))
    money = ("revenue", "operating_result", "annual_result", "assets", "equity", "debt")
    return rows.select(
        "org", "position", "period_start", "period_end", "currency", *[F.col(name).cast("bigint").alias(name) for name in money]
    )


@check(
    "S9_account_years",
    sql=b.with_ctes(
        b.ACCOUNTS_SQL,
        f"""SELECT org, CAST(row_number() OVER (PARTITION BY org ORDER BY period_end DESC) - 1 AS INTEGER) AS position,
          period_end[1:4] AS year, concat('{official.ACCOUNT_COPY_URL}', org, '/', period_end[1:4]) AS url FROM accounts""",
    ),
)
def account_years(spark: SparkSession, d: str) -> DataFrame:
    return official.account_copies(rec.responses(spark, d, "financial_history"))


@check(
    "S10_roles",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, 'LEDE' AS role_code, concat('Ola Nordmann ', k) AS name, 'STYR' AS group_code, false AS inactive FROM entity
          UNION ALL SELECT org, 'REVI', concat('Revisor ', k), 'STYR', k % 3 = 0 FROM entity
          UNION ALL SELECT org, 'DAGL', concat('Kari Nordmann ', k), 'DAGL', false FROM entity WHERE k % 2 = 0""",
    ),
)
def roles(spark: SparkSession, d: str) -> DataFrame:
    return official.roles(rec.responses(spark, d, "roles")).select("org", "role_code", "name", "group_code", "inactive")


@check(
    "S11_subunits",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CAST(i - 1 AS INTEGER) AS position, concat('Avdeling ', i) AS name,
          CASE WHEN i = 2 THEN '{"poststed":"Postboks 2"}' ELSE concat('{"poststed":"', municipality, '"}') END AS address,
          CAST(i AS INTEGER) AS employees FROM entity, range(1, 4) r(i) WHERE i <= k % 4""",
    ),
)
def subunits(spark: SparkSession, d: str) -> DataFrame:
    return official.subunits(rec.responses(spark, d, "locations")).select("org", "position", "name", "address", "employees")


@check(
    "S12_response_status",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT CASE k % 10 WHEN 5 THEN 'not_found' WHEN 7 THEN 'source_error' ELSE 'available' END AS status, count(*) AS n
          FROM entity GROUP BY 1""",
    ),
)
def response_status(spark: SparkSession, d: str) -> DataFrame:
    rows = rec.module_states(spark, d, "registry_live")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@check(
    "S13_snapshot_replay",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE WHEN k % 9 = 0 THEN 0 WHEN k % 10 = 5 THEN 404 WHEN k % 10 = 7 THEN 503 ELSE 200 END AS http_status,
          CASE WHEN k % 9 = 0 THEN 'source_error' WHEN k % 10 = 5 THEN 'not_found' WHEN k % 10 = 7 THEN 'source_error' ELSE 'available' END AS status,
          CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 IN (5, 7) THEN sha256('null')
            ELSE sha256(concat('{"a":"', name, '","b":[', k, ',null]}')) END AS content_sha256 FROM entity""",
    ),
)
def snapshot_replay(spark: SparkSession, d: str) -> DataFrame:
    entities = b.entity(spark, d)
    url = F.concat(F.lit(b.REGISTRY_URL), F.col("org"))
    requests = entities.select("org", F.lit("registry_live").alias("module"), url.alias("url"))
    held = entities.filter(F.pmod(rec.key(), F.lit(9)) != 0).select(
        url.alias("url"),
        rec.http_status().alias("status"),
        # Members stand in the other order; the canonical form sorts them.
        F.when(
            rec.http_status() == 200,
            F.concat(F.lit('{ "b": ['), rec.key().cast("string"), F.lit(', null], "a": "'), F.col("name"), F.lit('"}')),
        ).alias("body"),
        F.lit(None).cast("string").alias("retrieved_at"),
        F.lit(None).cast("string").alias("effective_at"),
    )
    rows = snapshots.replay(requests, held, b.RETRIEVED_AT)
    return rows.select(
        "org", F.col("status").alias("http_status"), official.response_status(F.col("status")).alias("status"), "content_sha256"
    )


# --- claims ------------------------------------------------------------------------------------

def _base_modules(spark: SparkSession, d: str) -> DataFrame:
    """The modules that base claims are made of: all but the live registry and the list of account years; the accounts without their bodies."""
    named = [name for name in rec.MODULES if name not in ("registry_live", "financial_history", "financials")]
    return rec.modules(spark, d, *named).unionByName(rec.account_states(spark, d))


def _settled(spark: SparkSession, d: str) -> DataFrame:
    """Base claims, each with its evidence: made once for both tables. Readers of claims read none of the evidence."""
    return stored(
        spark, d, "base-claims", lambda: c.settled_drafts(c.base_drafts(b.entity(spark, d), _base_modules(spark, d), rec.financials(spark, d)))
    )


def base_rows(spark: SparkSession, d: str) -> DataFrame:
    """Base claims for checks that do not look at evidence."""
    return _settled(spark, d).select(*CLAIM.fieldNames())


def base(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return c.split_settled(_settled(spark, d))


def _registry_claims_sql() -> str:
    parts = []
    for field, value in (
        ("legal_name", "concat('\"', name, '\"')"), ("legal_form", "concat('\"', legal_form, '\"')"),
        ("employee_count", "CAST(employees AS VARCHAR)"), ("municipality", "concat('\"', municipality, '\"')"),
        ("latest_submitted_accounts", "concat('\"', latest_submitted_accounts, '\"')"),
    ):
        digest = _sha("org", f"'registry:{field}'", f"'{b.REGISTRY_URL}bulk'", f"'{rec.BULK_SHA}'", "org")
        parts.append(
            f"SELECT org, '{field}' AS field, {value} AS value, 'available' AS availability, 1.0 AS confidence, "
            f"concat('ev-', {digest}[1:20]) AS evidence_id FROM entity WHERE {value} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


def _website_claims_sql() -> str:
    url = "concat('https://', website, '/')"
    sha = "sha256(concat('website|', org))"

    def evidence_id(field: str) -> str:
        return f"concat('ev-', {_sha('org', chr(39) + 'website:' + field + chr(39), url, sha, chr(39) * 2)}[1:20])"

    return f"""SELECT org, 'official_website' AS field, CASE WHEN k % 2 = 0 THEN concat('"', {url}, '"') END AS value,
        CASE WHEN k % 2 = 0 THEN 'available' ELSE 'ambiguous' END AS availability, CASE WHEN k % 2 = 0 THEN 0.95 ELSE 1.0 END AS confidence,
        {evidence_id("official_website")} AS evidence_id FROM entity WHERE website IS NOT NULL
      UNION ALL SELECT org, 'company_description', concat('"Om ', name, '"'), 'available', 0.95, {evidence_id("company_description")}
        FROM entity WHERE website IS NOT NULL AND k % 12 = 0
      UNION ALL SELECT org, 'social_links', concat('[{{"platform":"facebook","url":"https://facebook.com/kunde', k, '"}}]'), 'available', 0.95,
        {evidence_id("social_links")} FROM entity WHERE website IS NOT NULL AND k % 18 = 0"""


def _financial_claims_sql() -> str:
    parts = []
    period = "concat('{''fraDato'': ''', period_start, ''', ''tilDato'': ''', period_end, '''}')"
    for field in c.FINANCIAL_FIELDS:
        key = f"concat('financials:', {period}, ':financial.{field}')"
        digest = _sha("org", key, f"concat('{b.REGISTRY_URL}financials/', org)", "sha256(concat('financials|', org))", "''")
        parts.append(
            f"SELECT org, 'financial.{field}' AS field, CAST({field} AS VARCHAR) AS value, 'available' AS availability, "
            f"1.0 AS confidence, concat('ev-', {digest}[1:20]) AS evidence_id FROM fin WHERE {field} IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


@check(
    "P1_base_claims",
    sql=b.with_ctes(
        *_BASE, f"{_registry_claims_sql()} UNION ALL {_website_claims_sql()} UNION ALL {_financial_claims_sql()}"
    ),
)
def base_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = c.base_claims(b.entity(spark, d), _base_modules(spark, d), rec.financials(spark, d))
    # The structured modules have their own check.
    rows = claims.filter(~F.col("field").isin(*c.STRUCTURED_MODULES.values()))
    return rows.select("org", "field", "value", "availability", "confidence", F.explode("evidence_ids").alias("evidence_id"))


@check(
    "P1_module_claims",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT field, 'available' AS availability, (SELECT count(*) FROM entity) AS n
          FROM (VALUES ('accounting_obligation'), ('roles'), ('locations')) t(field)""",
    ),
)
def module_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = base_rows(spark, d)
    rows = claims.filter(F.col("field").isin(*c.STRUCTURED_MODULES.values()))
    return rows.groupBy("field", "availability").agg(F.count(F.lit(1)).alias("n"))


@check(
    "P1_module_errors",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, 'registry_live' AS module, 'source_error' AS status, 'HTTP 503' AS message,
          concat('{b.REGISTRY_URL}registry_live/', org) AS source_url FROM entity WHERE k % 10 = 7""",
    ),
)
def module_errors(spark: SparkSession, d: str) -> DataFrame:
    return c.module_errors(rec.module_states(spark, d, *rec.MODULES))


def _live_sql() -> str:
    values = {
        "industry": "concat('{\"code\":\"', industry_code, '\",\"description\":\"', label, '\"}')",
        "municipality_number": "concat('\"', municipality_number, '\"')",
        "bankrupt": "CAST(bankrupt AS VARCHAR)",
        "registered_address": (
            "concat('{\"adresse\":[\"Gata ', k, '\"],\"kommune\":\"', municipality, '\",\"kommunenummer\":\"', municipality_number, '\"}')"
        ),
        "registered_contact_email": "CASE WHEN k % 4 = 0 THEN concat('\"post@kunde', k, '.example.no\"') END",
    }
    parts = []
    for field, path in c.LIVE_SOURCE_PATHS.items():
        value = values.get(field, "CAST(NULL AS VARCHAR)")
        digest = _sha(
            "org", "'c12-registry-live'", f"'{field}'", f"'{path}'", f"concat('{b.REGISTRY_URL}registry_live/', org)",
            "sha256(concat('registry_live|', org))",
        )
        parts.append(
            f"SELECT org, '{field}' AS field, {value} AS value, concat('ev-c12-registry-live-', {digest}[1:20]) AS evidence_id "
            f"FROM entity WHERE {rec.LIVE_OK_SQL}"
        )
    return " UNION ALL ".join(parts)


@check(
    "P2_live_registry_claims",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT *, CASE WHEN value IS NULL THEN 'not_available' ELSE 'available' END AS availability FROM ({_live_sql()})""",
    ),
)
def live_registry_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, _ = c.live_registry_claims(rec.modules(spark, d, "registry_live"))
    return claims.select("org", "field", "value", "availability", F.explode("evidence_ids").alias("evidence_id"))


@check(
    "P3_registry_narrative",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, 'registered_purpose' AS field, 'Å drive handel' AS text FROM entity WHERE {rec.LIVE_OK_SQL} AND k % 3 = 0
          UNION ALL SELECT org, 'company_description', concat('Handel med ', label) FROM entity
            WHERE {rec.LIVE_OK_SQL} AND k % 2 = 0 AND NOT k % 12 = 0""",
    ),
)
def registry_narrative(spark: SparkSession, d: str) -> DataFrame:
    claims = base_rows(spark, d)
    narrative, _ = c.narrative_claims(claims, rec.modules(spark, d, "registry_live"))
    return narrative.select("org", "field", json_text(F.col("value")).alias("text"))


@check(
    "P4_registry_workforce",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, CAST(employees AS VARCHAR) AS employees, concat('brreg-workforce-', {_sha(
            "org", "employees", f"concat('{b.REGISTRY_URL}registry_live/', org)", "sha256(concat('registry_live|', org))")}[1:24]) AS id
          FROM entity WHERE {rec.LIVE_OK_SQL} AND employees IS NOT NULL""",
    ),
)
def registry_workforce(spark: SparkSession, d: str) -> DataFrame:
    rows = c.registry_workforce(rec.modules(spark, d, "registry_live"))
    return rows.select("org", F.col("metrics")["employees"].alias("employees"), "id")


def all_claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Base, live, narrative, award and change claims in one pair of tables."""
    return all_claim_rows(spark, d), stored(spark, d, "evidence", lambda: _replaced(spark, d, *base(spark, d))[1])


def all_claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """The claims of :func:`all_claims` alone; no evidence is put together for them, and base claims are not written a second time."""
    return c.replace_claims(base_rows(spark, d), _managed_claims(spark, d))


def _families(spark: SparkSession, d: str) -> list[tuple[str, Column, tuple[DataFrame, DataFrame]]]:
    modules = rec.modules(spark, d, "registry_live")
    live = stored(spark, d, "live-settled", lambda: c.settled_live(spread(modules)))
    awards = stored(spark, d, "selected-awards", lambda: selected_awards(spark, d))
    changes = stored(spark, d, "selected-changes", lambda: selected_changes(spark, d))
    return [
        ("live", c.owns_live_claim(), c.split_live(live)),
        ("narrative", c.owns_narrative_claim(), c.narrative_claims(base_rows(spark, d), modules)),
        ("award", F.col("field") == AWARD_FIELD, award_claims(awards, b.RETRIEVED_AT)),
        ("change", F.col("field") == CHANGE_FIELD, change_claims(changes, b.RETRIEVED_AT, b.REGISTRY_URL)),
    ]


def _managed_claims(spark: SparkSession, d: str) -> list[tuple[Column, DataFrame]]:
    """The claims of every family, stored; those of the live registry are, with their evidence."""
    return [
        (owned, pair[0] if name == "live" else stored(spark, d, f"{name}-claims", lambda claims=pair[0]: claims)) for name, owned, pair in _families(spark, d)
    ]


def evidence_rows(spark: SparkSession, d: str, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The evidence of :func:`all_claims` for checks that read it once: not stored, and only what they read of it is moved. See ``replaced_evidence``."""
    families = _families(spark, d)
    managed = reduce(lambda left, right: left | right, [F.coalesce(owned, F.lit(False)) for _, owned, _ in families])
    return c.replaced_evidence(_settled(spark, d), managed, union_all(*[pair[1] for _, _, pair in families]), shape)


def _replaced(spark: SparkSession, d: str, claims: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    return c.replace_families(claims, evidence, [(owned, pair) for _, owned, pair in _families(spark, d)])


@check(
    "P14_P15_managed_replace_is_idempotent",
    sql="SELECT 0 AS claims_changed, 0 AS evidence_changed",
)
def managed_replace_is_idempotent(spark: SparkSession, d: str) -> DataFrame:
    pair = award_claims(selected_awards(spark, d), b.RETRIEVED_AT)
    claims, evidence = base(spark, d)
    once = c.replace_managed(claims, evidence, F.col("field") == AWARD_FIELD, *pair)
    twice = c.replace_managed(*once, F.col("field") == AWARD_FIELD, *pair)

    def changed(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        return table_difference(left, right).select((F.col("only_left") + F.col("only_right")).cast("int").alias(name))

    one = changed(once[0], twice[0], "claims_changed")
    return one.join(F.broadcast(changed(once[1], twice[1], "evidence_changed")), F.lit(True))


def broken_contract(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, claims and evidence of the customers with planted faults."""
    orders = b.table(spark, d, "orders")
    key = F.col("o_orderkey")
    org = b.org_of("o_custkey")
    ev = F.concat(F.lit("ev-"), key.cast("string"))
    state = F.when(F.pmod(key, F.lit(13)) == 0, F.lit("odd")).when(F.pmod(key, F.lit(5)) == 0, F.lit("not_available")).otherwise(
        F.lit("available")
    )
    claims = orders.select(
        org.alias("org"),
        key.cast("string").alias("claim_order"),
        F.concat(F.lit("f"), key.cast("string")).alias("field"),
        F.lit("1").alias("value"),
        state.alias("availability"),
        F.when(F.pmod(key, F.lit(17)) == 0, F.array().cast("array<string>"))
        .when(F.pmod(key, F.lit(19)) == 0, F.array(F.concat(F.lit("gone-"), key.cast("string"))))
        .otherwise(F.array(ev))
        .alias("evidence_ids"),
    )
    base_evidence = orders.select(
        org.alias("org"),
        ev.alias("id"),
        F.when(F.pmod(key, F.lit(23)) != 0, F.lit("https://a.example/")).alias("source_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.lit("span").alias("claim_span"),
    )
    again = base_evidence.filter(F.pmod(F.substring("id", 4, 20).cast("bigint"), F.lit(29)) == 0)
    runs = b.table(spark, d, "customer").select(
        b.org_of("c_custkey").alias("org"),
        F.when(F.pmod("c_custkey", F.lit(31)) != 0, F.lit("run-1")).alias("run_id"),
        F.lit("s").alias("started_at"),
        F.lit("c").alias("completed_at"),
        F.lit("completed").alias("terminal_status"),
        F.when(F.pmod("c_custkey", F.lit(37)) == 0, F.lit(-1)).otherwise(F.lit(3)).alias("requests"),
        F.lit(0.0).alias("cost_usd"),
    )
    return runs, conform(claims, CLAIM), conform(base_evidence.unionByName(again), EVIDENCE)


@check(
    "F5_contract_violations",
    sql="""WITH o AS (SELECT CAST(800000000 + o_custkey AS VARCHAR) AS org, o_orderkey AS k FROM orders)
      SELECT org, 'claim has invalid availability' AS rule, concat('f', k) AS subject FROM o WHERE k % 13 = 0
      UNION ALL SELECT org, 'claim has value while unavailable', concat('f', k) FROM o WHERE k % 13 = 0 OR k % 5 = 0
      UNION ALL SELECT org, 'claim lacks evidence ids', concat('f', k) FROM o WHERE k % 17 = 0 AND k % 13 <> 0 AND k % 5 <> 0
      UNION ALL SELECT org, 'claim references missing evidence', concat('f', k, ':gone-', k) FROM o WHERE k % 19 = 0 AND k % 17 <> 0
      UNION ALL SELECT org, 'evidence missing source_url', concat('ev-', k) FROM o WHERE k % 23 = 0
      UNION ALL SELECT org, 'evidence missing source_url', concat('ev-', k) FROM o WHERE k % 23 = 0 AND k % 29 = 0
      UNION ALL SELECT org, 'duplicate or missing evidence ids', concat('ev-', k) FROM o WHERE k % 29 = 0
      UNION ALL SELECT CAST(800000000 + c_custkey AS VARCHAR), 'missing run.run_id', CAST(800000000 + c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 31 = 0
      UNION ALL SELECT CAST(800000000 + c_custkey AS VARCHAR), 'operations.requests is negative', CAST(800000000 + c_custkey AS VARCHAR)
        FROM customer WHERE c_custkey % 37 = 0""",
)
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return c.contract_violations(*broken_contract(spark, d))


_WANTED = ("registry", "registry_live", "financials", "website")


@check(
    "F8_terminal_envelopes",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.ACCOUNTS_SQL,
        """states AS (
          SELECT org, 'complete' AS a, CASE k % 10 WHEN 5 THEN 'not_found' WHEN 7 THEN 'source_error' ELSE 'complete' END AS b,
            CASE WHEN org IN (SELECT org FROM accounts) THEN 'complete' ELSE 'submission_error' END AS c,
            CASE WHEN website IS NULL THEN 'submission_error' ELSE 'complete' END AS d FROM entity
        ) SELECT org, CASE WHEN 'submission_error' IN (a, b, c, d) THEN 'submission_error' ELSE 'complete' END AS state FROM states""",
    ),
)
def terminal_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return c.entity_states(c.terminal_envelopes(b.entity(spark, d), rec.module_states(spark, d, *_WANTED), _WANTED))


@check(
    "F8_envelope_checks",
    sql="""SELECT true AS exact_expected_count, true AS unique_organisation_numbers, true AS all_module_states_terminal,
      true AS zero_silent_drops""",
)
def envelope_checks(spark: SparkSession, d: str) -> DataFrame:
    orgs = b.entity(spark, d)
    states = c.terminal_envelopes(orgs, rec.module_states(spark, d, *_WANTED), _WANTED)
    # The expected count of a batch is a number the caller knows; here it is the row count of the customer table.
    return c.envelope_checks(orgs, states, b.table(spark, d, "customer").count())


# --- refresh -----------------------------------------------------------------------------------

def _snapshot(spark: SparkSession, d: str, old: bool) -> DataFrame:
    return stored(spark, d, "snapshot-old" if old else "snapshot-new", lambda: _tracked(spark, d, old))


def _tracked(spark: SparkSession, d: str, old: bool) -> DataFrame:
    """Tracked values before and after the cut-off: accounts change with new orders, some names change too."""
    entities = b.entity(spark, d)
    if old:
        entities = entities.withColumn(
            "name", F.when(F.pmod(rec.key(), F.lit(21)) == 0, F.concat("name", F.lit(" (gammel)"))).otherwise(F.col("name"))
        )
    bulk = rec.modules(spark, d, "registry", "website")
    money = rec.financials(spark, d, b.OLD_SNAPSHOT_BEFORE if old else None)
    # Three records per company at most.
    listed = money.groupBy("org").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("position", "period_end", "revenue")))).alias("records")
    )
    accounts = listed.select(
        "org", F.lit("financials").alias("module"), F.lit("available").alias("status"),
        F.lit("official_annual_accounts").alias("source_type"), F.lit(b.ACCOUNTS_URL).alias("source_url"),
        F.lit(b.RETRIEVED_AT).alias("retrieved_at"),
        F.concat(F.lit('{"records":'), F.col("records"), F.lit("}")).alias("value"),
        F.sha2("records", 256).alias("content_sha256"), F.lit("2024-01-31").alias("effective_at"),
    )
    return rf.tracked_values(entities, bulk.unionByName(conform(accounts, MODULE_EVIDENCE)))


def refresh_changes(spark: SparkSession, d: str) -> DataFrame:
    return rf.with_change_id(rf.diff_snapshots(_snapshot(spark, d, True), _snapshot(spark, d, False)))


_DIFF_SQL = (
    b.ENTITY_SQL,
    b.accounts_sql("accounts_old", b.OLD_SNAPSHOT_BEFORE),
    b.ACCOUNTS_SQL,
    rec.financials_sql("fin_old", "accounts_old"),
    rec.financials_sql(),
    """lists AS (
      SELECT coalesce(o.org, n.org) AS org, o.v AS old_v, n.v AS new_v FROM
        (SELECT org, concat('[', string_agg(concat('{"period_end":"', period_end, '","position":', position, ',"revenue":', revenue, '}'), ',' ORDER BY position), ']') AS v FROM fin_old GROUP BY org) o
        FULL JOIN (SELECT org, concat('[', string_agg(concat('{"period_end":"', period_end, '","position":', position, ',"revenue":', revenue, '}'), ',' ORDER BY position), ']') AS v FROM fin GROUP BY org) n
        ON o.org = n.org
    ), diff AS (
      SELECT org, 'financials.records' AS field, old_v AS previous_value, new_v AS current_value FROM lists WHERE old_v IS DISTINCT FROM new_v
      UNION ALL SELECT org, 'registry.name', concat('"', name, ' (gammel)"'), concat('"', name, '"') FROM entity WHERE k % 21 = 0
    )""",
)


@check("J19_snapshot_diff", sql=b.with_ctes(*_DIFF_SQL, "SELECT org, field, previous_value, current_value FROM diff"))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return refresh_changes(spark, d).select("org", "field", "previous_value", "current_value")


@check(
    "F9_change_errors",
    sql=b.with_ctes(
        *_DIFF_SQL,
        """SELECT field, CASE WHEN field = 'financials.records' AND previous_value IS NULL THEN 'invalid previous_content_sha256'
            WHEN field = 'financials.records' AND current_value IS NULL THEN 'missing source_url' ELSE 'none' END AS error, count(*) AS n
          FROM diff GROUP BY 1, 2""",
    ),
)
def change_errors(spark: SparkSession, d: str) -> DataFrame:
    checked = rf.validate_changes(refresh_changes(spark, d))
    first = F.coalesce(F.try_element_at("errors", F.lit(1)), F.lit("none"))
    return checked.groupBy("field", first.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "P19_grouped_changes",
    sql=b.with_ctes(
        *_DIFF_SQL,
        """SELECT org, field, CAST(row_number() OVER (PARTITION BY org ORDER BY field) AS INTEGER) AS position FROM diff
          WHERE (previous_value IS NOT NULL AND current_value IS NOT NULL OR field <> 'financials.records')
            AND org IN (SELECT org FROM entity WHERE NOT bankrupt)""",
    ),
)
def grouped_changes(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = rf.group_changes(refresh_changes(spark, d), b.entity(spark, d).filter(~F.col("bankrupt")))
    return valid.select("org", "field", "position")


@check(
    "P19_grouping_violations",
    sql=b.with_ctes(
        *_DIFF_SQL,
        """SELECT problem, count(*) AS n FROM (
            SELECT 'organisation outside output batch' AS problem FROM diff WHERE org IN (SELECT org FROM entity WHERE bankrupt)
            UNION ALL SELECT 'invalid change' FROM diff WHERE field = 'financials.records' AND (previous_value IS NULL OR current_value IS NULL))
          GROUP BY 1""",
    ),
)
def grouping_violations(spark: SparkSession, d: str) -> DataFrame:
    _, violations = rf.group_changes(refresh_changes(spark, d), b.entity(spark, d).filter(~F.col("bankrupt")))
    return violations.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A17_replay_score",
    sql=b.with_ctes(
        *_DIFF_SQL,
        """expected AS (SELECT org, 'registry.name' AS field FROM entity WHERE k % 42 = 0 OR k % 100 = 1
            UNION SELECT org, field FROM diff WHERE field = 'financials.records'),
        s AS (SELECT count(*) FILTER (WHERE d.org IS NOT NULL AND e.org IS NOT NULL) AS true_positive,
            count(*) FILTER (WHERE e.org IS NULL) AS false_positive, count(*) FILTER (WHERE d.org IS NULL) AS false_negative
          FROM diff d FULL JOIN expected e ON d.org = e.org AND d.field = e.field)
        SELECT *, round(true_positive / (true_positive + false_positive), 9) AS "precision",
          round(true_positive / (true_positive + false_negative), 9) AS recall FROM s""",
    ),
)
def replay_score(spark: SparkSession, d: str) -> DataFrame:
    observed = refresh_changes(spark, d)
    number = rec.key()
    names = b.entity(spark, d).filter((F.pmod(number, F.lit(42)) == 0) | (F.pmod(number, F.lit(100)) == 1))
    expected = names.select("org", F.lit("registry.name").alias("field")).unionByName(
        observed.filter(F.col("field") == "financials.records").select("org", "field")
    )
    return rf.replay_score(expected, observed).select(
        "true_positive", "false_positive", "false_negative", F.round("precision", 9).alias("precision"),
        F.round("recall", 9).alias("recall"),
    )


# --- facts -------------------------------------------------------------------------------------

def facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fact_rows(spark, d), evidence_rows(spark, d)


def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "facts", lambda: can.project_facts(all_claim_rows(spark, d)))


_FACT_COUNTS_SQL = f"""SELECT 'company_name' AS type, count(*) AS n FROM entity
  UNION ALL SELECT 'legal_form', count(*) FROM entity
  UNION ALL SELECT 'municipality', count(*) FROM entity
  UNION ALL SELECT 'latest_submitted_accounts', count(*) FROM entity
  UNION ALL SELECT 'accounting_obligation', count(*) FROM entity
  UNION ALL SELECT 'registered_employee_count', count(employees) FROM entity
  UNION ALL SELECT t, (SELECT count(*) FROM entity WHERE {rec.LIVE_OK_SQL}) FROM (VALUES ('industry'), ('municipality_number'), ('bankrupt'),
    ('liquidating'), ('forced_dissolution'), ('registration_date'), ('foundation_date'), ('articles_date'),
    ('registered_in_enterprise_register'), ('enterprise_register_date'), ('institutional_sector'), ('registered_capital'),
    ('registered_in_vat_register'), ('vat_registration_date'), ('registered_address'), ('postal_address'),
    ('registered_contact_email'), ('registered_phone'), ('registered_mobile')) v(t)
  UNION ALL SELECT 'registered_purpose', count(*) FROM entity WHERE {rec.LIVE_OK_SQL} AND k % 3 = 0
  UNION ALL SELECT 'company_description', count(*) FROM entity WHERE k % 12 = 0 OR ({rec.LIVE_OK_SQL} AND k % 2 = 0 AND k % 12 <> 0)
  UNION ALL SELECT 'website', count(website) FROM entity
  UNION ALL SELECT 'person_role', CAST(sum(1 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM entity
  UNION ALL SELECT 'registered_location', CAST(sum(k % 4) AS BIGINT) FROM entity
  UNION ALL SELECT 'financial_revenue', count(revenue) FROM fin
  UNION ALL SELECT 'financial_operating_result', count(operating_result) FROM fin
  UNION ALL SELECT 'financial_annual_result', count(annual_result) FROM fin
  UNION ALL SELECT 'financial_assets', count(assets) FROM fin
  UNION ALL SELECT 'financial_debt', count(debt) FROM fin"""


@check("P16_canonical_facts", sql=b.with_ctes(*_BASE, f"SELECT * FROM ({_FACT_COUNTS_SQL}) WHERE n > 0"))
def canonical_facts(spark: SparkSession, d: str) -> DataFrame:
    rows = can.project_facts(all_claim_rows(spark, d))
    return (
        rows.filter(~F.col("type").isin("support_award", "registry_change")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    )


@check(
    "P16_fact_values",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT org, 'company.name' AS canonical_field, concat('"', name, '"') AS value FROM entity
          UNION ALL SELECT org, 'company.industry', concat('{{"code":"', industry_code, '","description":"', label, '"}}') FROM entity
            WHERE {rec.LIVE_OK_SQL}""",
    ),
)
def fact_values(spark: SparkSession, d: str) -> DataFrame:
    rows = fact_rows(spark, d)
    return rows.filter(F.col("type").isin("company_name", "industry")).select("org", "canonical_field", "value")


@check(
    "P17_data_areas",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        b.ACCOUNTS_SQL,
        f"""SELECT org, true AS company_record, org IN (SELECT org FROM accounts) AS financials, true AS people_and_locations,
          website IS NOT NULL AND k % 2 = 0 OR {rec.LIVE_OK_SQL} AND k % 2 = 0 OR k % 12 = 0 AS company_website FROM entity""",
    ),
)
def data_areas(spark: SparkSession, d: str) -> DataFrame:
    rows = fact_rows(spark, d)
    return can.data_areas(rows).select("org", "company_record", "financials", "people_and_locations", "company_website")


@check("F6_fact_violations", sql="SELECT CAST(NULL AS VARCHAR) AS rule, 0 AS n WHERE false")
def fact_violations(spark: SparkSession, d: str) -> DataFrame:
    rows, evidence = facts(spark, d)
    return can.fact_violations(rows, evidence).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@check(
    "F6_planted_fact_violations",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT rule, (SELECT count(*) FROM entity) AS n FROM (VALUES ('unexpected canonical_field'), ('references missing evidence')) t(rule)
          UNION ALL SELECT 'fact outside the categories', count(*) FROM entity""",
    ),
)
def planted_fact_violations(spark: SparkSession, d: str) -> DataFrame:
    rows, evidence = facts(spark, d)
    # Company names under a type that no category knows, pointing to evidence that does not exist.
    odd = rows.filter(F.col("type") == "company_name").withColumn("type", F.lit("nickname")).withColumn(
        "evidence_ids", F.array(F.lit("ev-none"))
    )
    return can.fact_violations(rows.unionByName(odd), evidence).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@check(
    "A13_fact_metrics",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        f"""SELECT 'companies_by_area' AS metric, 'company_record' AS label, count(*) AS n FROM entity
          UNION ALL SELECT 'companies_by_area', 'people_and_locations', count(*) FROM entity
          UNION ALL SELECT 'facts_by_type', 'company_name', count(*) FROM entity
          UNION ALL SELECT 'facts_by_type', 'industry', count(*) FROM entity WHERE {rec.LIVE_OK_SQL}""",
    ),
)
def fact_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = fact_rows(spark, d)
    return can.fact_metrics(rows).filter(F.col("label").isin("company_record", "people_and_locations", "company_name", "industry"))


@check(
    "A13_role_counts",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT CAST(sum(1 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS active,
          count(*) FILTER (WHERE k % 3 = 0) AS inactive, CAST(sum(2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS total FROM entity""",
    ),
)
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    claims = base_rows(spark, d)
    return can.role_counts(claims)


@check(
    "W15_latest_financials",
    sql=b.with_ctes(
        *_BASE,
        """SELECT org, 'financial_revenue' AS type, period_end, CAST(revenue AS VARCHAR) AS value FROM fin WHERE position = 0
          UNION ALL SELECT org, 'financial_debt', max(period_end), max_by(CAST(debt AS VARCHAR), period_end) FROM fin
            WHERE debt IS NOT NULL GROUP BY org""",
    ),
)
def latest_financials(spark: SparkSession, d: str) -> DataFrame:
    claims = base_rows(spark, d)
    rows = can.latest_financials(can.project_facts(claims)).filter(F.col("type").isin("financial_revenue", "financial_debt"))
    return rows.select("org", "type", can.period_end(F.col("reporting_period")).alias("period_end"), "value")


@check(
    "W16_leaders",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE WHEN k % 2 = 0 THEN concat('Kari Nordmann ', k) ELSE concat('Ola Nordmann ', k) END AS name,
          CASE WHEN k % 2 = 0 THEN 'DAGL' ELSE 'LEDE' END AS role_code FROM entity""",
    ),
)
def leaders(spark: SparkSession, d: str) -> DataFrame:
    claims = base_rows(spark, d)
    rows = can.leaders(can.project_facts(claims))
    return rows.select(
        "org", F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.role_code").alias("role_code")
    )
