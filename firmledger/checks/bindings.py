"""Input tables derived from the test tables, once in Spark and once as SQL common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AWARDS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-25T00:00:00Z"
OLD_SNAPSHOT_BEFORE = "2000-01-01"
REGISTRY_URL = "https://registry.example/units/"
ACCOUNTS_URL = "https://accounts.example/"
RETRIEVED_AT = "2024-02-01T00:00:00Z"

ORG_BASE = 800_000_000
PAGE_ORG_BASE = 810_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def org_of(key: str | F.Column, base: int = ORG_BASE):
    column = F.col(key) if isinstance(key, str) else key
    return (column + F.lit(base)).cast("string")


# --- B1: entities ------------------------------------------------------------------------------

def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    form = (
        F.when(F.col("c_mktsegment") == "BUILDING", "AS")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "ASA")
        .when(F.col("c_mktsegment") == "MACHINERY", "ENK")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "SA")
        .otherwise("KF")
    )
    # nation is a fixed dimension of 25 rows.
    return customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select(
        org_of("c_custkey").alias("org"),
        F.concat_ws(
            " ", F.lit("Kunde"), key.cast("string"), F.initcap("c_mktsegment"), F.col("n_name"), form
        ).alias("name"),
        form.alias("legal_form"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100)).cast("int").alias("employees"),
        (F.pmod(key, F.lit(50)) == 0).alias("bankrupt"),
        (F.pmod(key, F.lit(70)) == 0).alias("liquidating"),
        F.col("n_name").alias("municipality"),
        F.lpad((F.col("n_nationkey") * 100 + 1).cast("string"), 4, "0").alias("municipality_number"),
        F.concat_ws(
            ".",
            (F.col("n_nationkey") + 10).cast("string"),
            F.lpad(F.pmod(key, F.lit(100)).cast("string"), 2, "0"),
        ).alias("industry_code"),
        F.initcap("c_mktsegment").alias("industry_label"),
        F.when(
            F.pmod(key, F.lit(3)) == 0,
            F.concat(F.lit("www.kunde"), F.pmod(key, F.lit(600)).cast("string"), F.lit(".example.no")),
        ).alias("website"),
        F.when(F.pmod(key, F.lit(4)) != 0, F.lit("2025")).otherwise("2024").alias("latest_submitted_accounts"),
    )


ENTITY_SQL = """entity AS (
  SELECT e.*,
    concat('Kunde ', k, ' ', label, ' ', municipality, ' ', legal_form) AS name
  FROM (
    SELECT c_custkey AS k, CAST(800000000 + c_custkey AS VARCHAR) AS org,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'AS' WHEN 'AUTOMOBILE' THEN 'ASA' WHEN 'MACHINERY' THEN 'ENK'
        WHEN 'HOUSEHOLD' THEN 'SA' ELSE 'KF' END AS legal_form,
      CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS INTEGER) END AS employees,
      c_custkey % 50 = 0 AS bankrupt, c_custkey % 70 = 0 AS liquidating,
      n_name AS municipality, lpad(CAST(n_nationkey * 100 + 1 AS VARCHAR), 4, '0') AS municipality_number,
      concat(n_nationkey + 10, '.', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')) AS industry_code,
      concat(upper(c_mktsegment[1:1]), lower(c_mktsegment[2:])) AS label,
      CASE WHEN c_custkey % 3 = 0 THEN concat('www.kunde', c_custkey % 600, '.example.no') END AS website,
      CASE WHEN c_custkey % 4 <> 0 THEN '2025' ELSE '2024' END AS latest_submitted_accounts
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  ) e
)"""


# --- B2: award rows as they stand in the source file ---------------------------------------------

AWARD_HEADERS = {
    "recipient": "Mottaker organisasjonsnummer",
    "award_date": "Tildelingsdato",
    "amount": "Tildelt beløp",
    "currency": "Tildelt beløp valuta",
    "status": "Status",
    "measure_number": "Støttetiltaksnummer",
    "measure_type": "Støttetiltakstype",
}


def award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award file rows with their source headers and with mixed date, amount and number shapes."""
    orders = table(spark, sf_dir, "orders")
    shape = F.pmod(F.col("o_orderkey"), F.lit(3))
    org = org_of("o_custkey")
    spaced = F.concat_ws(" ", org.substr(1, 3), org.substr(4, 3), org.substr(7, 3))
    recipient = (
        F.when(shape == 0, F.concat(F.lit("NO "), spaced, F.lit(" MVA")))
        .when(shape == 1, org)
        .otherwise(F.concat(F.lit("Mottaker "), F.concat_ws(".", org.substr(1, 3), org.substr(4, 3), org.substr(7, 3))))
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("bigint"), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")

    def grouped(mark: str):
        return F.when(
            whole >= 1000,
            F.concat(
                F.floor(whole / 1000).cast("string"), F.lit(mark), F.lpad(F.pmod(whole, F.lit(1000)).cast("string"), 3, "0")
            ),
        ).otherwise(whole.cast("string"))

    amount = (
        F.when(shape == 0, F.concat(grouped("."), F.lit(","), part))
        .when(shape == 1, F.concat(grouped(","), F.lit("."), part))
        .otherwise(F.concat(whole.cast("string"), F.lit(","), part))
    )
    day = F.col("o_orderdate").cast("date")
    date_text = (
        F.when(shape == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 1, F.date_format(day, "dd.MM.yyyy"))
        .otherwise(F.date_format(day, "d/M/yyyy"))
    )
    return orders.select(
        recipient.alias(AWARD_HEADERS["recipient"]),
        date_text.alias(AWARD_HEADERS["award_date"]),
        amount.alias(AWARD_HEADERS["amount"]),
        F.lit("NOK").alias(AWARD_HEADERS["currency"]),
        F.col("o_orderstatus").alias(AWARD_HEADERS["status"]),
        F.col("o_orderkey").cast("string").alias(AWARD_HEADERS["measure_number"]),
        F.col("o_orderpriority").alias(AWARD_HEADERS["measure_type"]),
    )


AWARD_SQL = """award AS (
  SELECT a.*, sha256(concat('{"Mottaker organisasjonsnummer":"', recipient, '","Status":"', status,
      '","Støttetiltaksnummer":"', measure_number, '","Støttetiltakstype":"', measure_type,
      '","Tildelingsdato":"', date_text, '","Tildelt beløp":"', amount_text,
      '","Tildelt beløp valuta":"NOK"}')) AS row_sha
  FROM (
    SELECT o_orderkey, CAST(800000000 + o_custkey AS VARCHAR) AS org,
      CASE o_orderkey % 3
        WHEN 0 THEN concat('NO ', org[1:3], ' ', org[4:6], ' ', org[7:9], ' MVA')
        WHEN 1 THEN org ELSE concat('Mottaker ', org[1:3], '.', org[4:6], '.', org[7:9]) END AS recipient,
      CAST(o_orderdate AS DATE) AS award_date,
      CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
        ELSE concat(day(o_orderdate), '/', month(o_orderdate), '/', year(o_orderdate)) END AS date_text,
      CAST(round(o_totalprice * 100) AS BIGINT) AS cents, cents // 100 AS whole,
      lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS part,
      CASE o_orderkey % 3
        WHEN 0 THEN concat(CASE WHEN whole >= 1000 THEN concat(whole // 1000, '.', lpad(CAST(whole % 1000 AS VARCHAR), 3, '0'))
          ELSE CAST(whole AS VARCHAR) END, ',', part)
        WHEN 1 THEN concat(CASE WHEN whole >= 1000 THEN concat(whole // 1000, ',', lpad(CAST(whole % 1000 AS VARCHAR), 3, '0'))
          ELSE CAST(whole AS VARCHAR) END, '.', part)
        ELSE concat(whole, ',', part) END AS amount_text,
      o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS measure_number, o_orderpriority AS measure_type
    FROM orders
  ) a
)"""


# --- B3: registry change events ------------------------------------------------------------------

CHANGE_PATHS = {
    "signup": "/antallAnsatte",
    "purchase": "/naeringskode1",
    "view": "/forretningsadresse/adresse",
    "click": "/ukjent/felt",
}


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per change; every tenth event is delivered twice with a later sequence number."""
    events = table(spark, sf_dir, "events")
    path = F.lit("/annet")
    for event_type, name in CHANGE_PATHS.items():
        path = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(path)
    k = F.get_json_object("props", "$.k")
    op = (
        F.when(F.col("event_type").isin("signup", "click"), F.lit("add"))
        .when((F.col("event_type") == "view") & (F.pmod(F.col("event_id"), F.lit(7)) == 0), F.lit("remove"))
        .when(F.col("event_type") == "error", F.lit("remove"))
        .otherwise(F.lit("replace"))
    )
    base = events.select(
        org_of("user_id").alias("org"),
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dato"),
        F.col("event_type").alias("event_type"),
        path.alias("path"),
        op.alias("op"),
        F.when(op != "remove", k).alias("value"),
        F.lit(0).alias("seq"),
    )
    again = base.filter(F.pmod(F.col("event_id").cast("bigint"), F.lit(10)) == 0).withColumn("seq", F.lit(1))
    return base.unionByName(again)


CHANGE_SQL = """change_base AS (
  SELECT CAST(800000000 + user_id AS VARCHAR) AS org, CAST(event_id AS VARCHAR) AS event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS dato, event_type,
    CASE event_type WHEN 'signup' THEN '/antallAnsatte' WHEN 'purchase' THEN '/naeringskode1'
      WHEN 'view' THEN '/forretningsadresse/adresse' WHEN 'click' THEN '/ukjent/felt' ELSE '/annet' END AS path,
    CASE WHEN event_type IN ('signup', 'click') THEN 'add' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'remove'
      WHEN event_type = 'error' THEN 'remove' ELSE 'replace' END AS op,
    CASE WHEN op <> 'remove' THEN json_extract_string(props, '$.k') END AS value
  FROM events
), change AS (
  SELECT *, 0 AS seq FROM change_base
  UNION ALL SELECT *, 1 FROM change_base WHERE CAST(event_id AS BIGINT) % 10 = 0
)"""


# --- B4: yearly accounts -------------------------------------------------------------------------

def accounts(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Accounts per customer and year in whole cents; equity is never reported."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if before:
        orders = orders.filter(F.col("o_orderdate") < F.lit(before).cast("date"))
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    discount = F.round(F.col("l_discount") * 100).cast("bigint")
    # Lines are summed per order first, so the join moves one row per order.
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(price).alias("revenue"),
            F.sum(price * discount).alias("rebate"),
            F.sum(F.when(F.col("l_linestatus") == "O", price)).alias("debt"),
        )
    )
    year = F.year("o_orderdate")
    yearly = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(org_of("o_custkey").alias("org"), year.alias("year"))
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("rebate").alias("rebate"),
            F.sum("debt").alias("debt"),
        )
    )
    return yearly.select(
        "org",
        F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("period_start"),
        F.concat(F.col("year").cast("string"), F.lit("-12-31")).alias("period_end"),
        F.lit("NOK").alias("currency"),
        "revenue",
        (F.col("revenue") - F.floor(F.col("rebate") / 100)).cast("bigint").alias("operating_result"),
        F.lit(None).cast("bigint").alias("profit_before_tax"),
        F.floor((F.col("revenue") - F.col("rebate") / 50) / 1000).cast("bigint").alias("annual_result"),
        (F.col("revenue") * 2).alias("assets"),
        F.lit(None).cast("bigint").alias("equity"),
        "debt",
    )


def accounts_sql(name: str = "accounts", before: str | None = None) -> str:
    condition = f"WHERE o_orderdate < DATE '{before}'" if before else ""
    return f"""{name} AS (
  SELECT org, concat(y, '-01-01') AS period_start, concat(y, '-12-31') AS period_end, 'NOK' AS currency, revenue,
    CAST(revenue - rebate // 100 AS BIGINT) AS operating_result, CAST(NULL AS BIGINT) AS profit_before_tax,
    CAST(floor((revenue - rebate / 50) / 1000) AS BIGINT) AS annual_result, CAST(revenue * 2 AS BIGINT) AS assets,
    CAST(NULL AS BIGINT) AS equity, debt
  FROM (
    SELECT CAST(800000000 + o_custkey AS VARCHAR) AS org, year(o_orderdate) AS y,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS rebate,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS debt
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey {condition}
    GROUP BY 1, 2
  )
)"""


ACCOUNTS_SQL = accounts_sql()


def org_valid_sql(org: str) -> str:
    """Mod-11 test of a nine-digit text, written with substrings."""
    weighted = " + ".join(
        f"CAST(substr({org}, {position + 1}, 1) AS INTEGER) * {weight}"
        for position, weight in enumerate((3, 2, 7, 6, 5, 4, 3, 2))
    )
    return f"((11 - ({weighted}) % 11) % 11 = CAST(substr({org}, 9, 1) AS INTEGER))"


def with_ctes(*parts_and_body: str) -> str:
    """``WITH a, b`` in front of the last argument, which may open with further table expressions."""
    *parts, body = parts_and_body
    glue = ",\n" if re.match(r"\s*\w+ AS \(", body) else "\n"
    return "WITH " + ",\n".join(parts) + glue + body
