"""Column-function checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, orgnum, text, values, web
from ..sources.awards import normalize_award_rows
from . import bindings as b
from .registry import check


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", "text")


@check(
    "X1_org_check_digit",
    sql=f"""SELECT CAST(800000000 + c_custkey AS VARCHAR) AS org,
      {b.org_valid_sql("CAST(800000000 + c_custkey AS VARCHAR)")} AS valid FROM customer""",
)
def org_check_digit(spark: SparkSession, d: str) -> DataFrame:
    org = b.org_of("c_custkey")
    return b.table(spark, d, "customer").select(org.alias("org"), orgnum.has_valid_check_digit(org).alias("valid"))


# Every run of digits gets a mark of its own on both sides, so two numbers may share the one character between them: the query looks at
# what surrounds a number without taking it, which this dialect's patterns cannot. The white space is that of the query.
_NUMBERS_SQL = r"""hits AS (
  SELECT doc_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '([0-9]+)', concat(chr(1), '\1', chr(2)), 'g'),
    '\x01([0-9]{3}(?:\x02[ \t\n\x0B\f\r\x{00A0}\x{2007}\x{202F}.\-]\x01)?[0-9]{3}(?:\x02[ \t\n\x0B\f\r\x{00A0}\x{2007}\x{202F}.\-]\x01)?[0-9]{3})\x02', 1)),
    '[^0-9]', '', 'g') AS number
  FROM documents
)"""


@check(
    "X2_org_numbers_in_text",
    sql=b.with_ctes(
        _NUMBERS_SQL,
        f"""SELECT doc_id, number FROM (SELECT DISTINCT doc_id, number FROM hits) WHERE {b.org_valid_sql("number")}""",
    ),
)
def org_numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.explode(orgnum.extract_org_numbers(F.col("text"))).alias("number"))


@check(
    "X2_org_numbers_in_award_text",
    sql=b.with_ctes(
        b.AWARD_SQL,
        f"SELECT measure_number, org FROM award WHERE {b.org_valid_sql('org')}",
    ),
)
def org_numbers_in_award_text(spark: SparkSession, d: str) -> DataFrame:
    rows = normalize_award_rows(b.award_rows(spark, d))
    return rows.select("measure_number", F.explode("recipient_orgs").alias("org"))


@check(
    "X3_labelled_org_numbers",
    sql="""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(100000000 + doc_id * 7 AS VARCHAR) AS number FROM documents
      WHERE doc_id % 3 <> 2""",
)
def labelled_org_numbers(spark: SparkSession, d: str) -> DataFrame:
    # Every document ends with its own number, labelled in two of three cases.
    number = (F.col("doc_id") * 7 + 100_000_000).cast("string")
    label = (
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("\nOrg.nr: "), number))
        .when(F.pmod("doc_id", F.lit(3)) == 1, F.concat(F.lit("\nNO "), number, F.lit(" MVA")))
        .otherwise(F.concat(F.lit("\nTlf "), number))
    )
    labelled = _documents(spark, d).withColumn("text", F.concat("text", label))
    return labelled.select("doc_id", F.explode(orgnum.extract_labelled_org_numbers(F.col("text"))).alias("number"))


_FOLD_SQL = """lower(regexp_replace(strip_accents(replace(replace(replace(replace({0}, 'æ', 'ae'), 'Æ', 'AE'), 'ø', 'o'), 'Ø', 'O')),
  '[^\\x00-\\x7F]', '', 'g'))"""


@check(
    "X4_folded_tokens",
    sql=f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256
      FROM (SELECT doc_id, regexp_extract_all({_FOLD_SQL.format("text")}, '[a-z0-9]+') AS t FROM documents)""",
)
def folded_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = _documents(spark, d).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"),
    )


_NAME_TOKENS_SQL = """names AS (
  SELECT org, list_filter(string_split(lower(name), ' '),
    lambda t: t NOT IN ('as','asa','ans','da','enk','iks','sa','sam','sti','stiftelsen','nuf','ab','limited','ltd','inc','plc')) AS raw
  FROM entity
), name_tokens AS (
  SELECT org, flatten(list_transform(raw, lambda t: regexp_extract_all(t, '[a-z0-9]+'))) AS t FROM names
)"""


@check(
    "X5_distinctive_name_tokens",
    sql=b.with_ctes(
        b.ENTITY_SQL, _NAME_TOKENS_SQL, "SELECT org, array_to_string(t, ' ') AS name_tokens, array_to_string(t, '') AS compact FROM name_tokens"
    ),
)
def distinctive_name_tokens(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    return b.entity(spark, d).select(
        "org",
        F.array_join(text.legal_name_tokens(name), " ").alias("name_tokens"),
        text.compact_name(name).alias("compact"),
    )


@check(
    "X6_acronym_aliases",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        _NAME_TOKENS_SQL,
        """SELECT org, array_to_string(list_sort(list_distinct(list_filter([
            array_to_string(t, ''),
            array_to_string(list_transform(t, lambda x: x[1:1]), ''),
            concat(t[1][1:3], array_to_string(list_transform(t[2:], lambda x: x[1:1]), '')),
            concat(t[1][1:4], array_to_string(list_transform(t[2:], lambda x: x[1:1]), ''))], lambda a: length(a) >= 3))), ',') AS aliases
          FROM name_tokens""",
    ),
)
def acronym_aliases(spark: SparkSession, d: str) -> DataFrame:
    aliases = text.acronym_aliases(text.legal_name_tokens(F.col("name")))
    return b.entity(spark, d).select("org", F.array_join(F.array_sort(aliases), ",").alias("aliases"))


_HOST_SQL = "lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), ':[0-9]*$', ''))"


@check(
    "X7_host_and_site",
    sql=f"""SELECT page_id, {_HOST_SQL} AS host,
      {_HOST_SQL} = 'example.com' OR {_HOST_SQL} LIKE '%.example.com' AS on_example_com FROM pages""",
)
def host_and_site(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return b.table(spark, d, "pages").select(
        "page_id",
        web.url_host(url).alias("host"),
        web.same_site(url, F.lit("https://example.com/om-oss")).alias("on_example_com"),
    )


@check(
    "X8_normalized_homepage",
    sql="""SELECT page_id, concat(lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)), '://', regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1),
        CASE WHEN path = '' THEN '/' ELSE path END) AS homepage,
      concat('https://', regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '/') AS from_host
      FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""",
)
def normalized_homepage(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select(
        "page_id",
        web.normalize_homepage(F.col("url")).alias("homepage"),
        web.normalize_homepage(web.url_authority(F.col("url"))).alias("from_host"),
    )


@check(
    "X10_valid_domain",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, website IS NOT NULL AS website_valid, false AS name_valid, k % 10 > 0 AS label_valid FROM entity""",
    ),
)
def valid_domain(spark: SparkSession, d: str) -> DataFrame:
    # A label that ends with a hyphen is never valid.
    key = F.col("org").substr(9, 1).cast("int")
    label = F.concat(F.lit("kunde"), F.when(key == 0, F.lit("-")).otherwise(key.cast("string")), F.lit(".no"))
    return b.entity(spark, d).select(
        "org",
        web.is_valid_domain(F.col("website")).alias("website_valid"),
        web.is_valid_domain(F.col("name")).alias("name_valid"),
        web.is_valid_domain(label).alias("label_valid"),
    )


@check(
    "X11_registered_domain",
    sql=f"""SELECT page_id, array_to_string(string_split({_HOST_SQL}, '.')[-2:], '.') AS domain FROM pages""",
)
def registered_domain(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select("page_id", web.registered_domain(F.col("url")).alias("domain"))


@check(
    "X12_award_dates",
    sql=b.with_ctes(b.AWARD_SQL, "SELECT measure_number, CAST(award_date AS VARCHAR) AS award_date FROM award"),
)
def award_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = b.award_rows(spark, d)
    return rows.select(
        F.col(b.AWARD_HEADERS["measure_number"]).alias("measure_number"),
        text.parse_award_date(F.col(b.AWARD_HEADERS["award_date"])).cast("string").alias("award_date"),
    )


@check(
    "X13_award_amounts",
    sql=b.with_ctes(b.AWARD_SQL, "SELECT measure_number, concat(whole, '.', part, '0000') AS amount FROM award"),
)
def award_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = b.award_rows(spark, d)
    return rows.select(
        F.col(b.AWARD_HEADERS["measure_number"]).alias("measure_number"),
        text.parse_amount(F.col(b.AWARD_HEADERS["amount"])).cast("string").alias("amount"),
    )


@check(
    "X15_material_ids",
    sql=b.with_ctes(
        b.CHANGE_SQL,
        "SELECT event_id, seq, concat('ev-', sha256(concat(org, '|', event_id, '|', coalesce(value, '')))[1:20]) AS id FROM change",
    ),
)
def material_ids(spark: SparkSession, d: str) -> DataFrame:
    return b.change_rows(spark, d).select(
        "event_id", F.col("seq").alias("seq"), ids.material_id("ev-", 20, F.col("org"), F.col("event_id"), F.col("value")).alias("id")
    )


@check(
    "X16_canonical_row_hash",
    sql=b.with_ctes(
        b.CHANGE_SQL,
        """SELECT event_id, seq, sha256(concat('{"op":"', op, '","org":"', org, '","path":"', path, '","value":',
          CASE WHEN value IS NULL THEN 'null' ELSE concat('"', value, '"') END, '}')) AS hash FROM change""",
    ),
)
def canonical_row_hash(spark: SparkSession, d: str) -> DataFrame:
    return b.change_rows(spark, d).select(
        "event_id", "seq", ids.canonical_hash(["value", "path", "org", "op"]).alias("hash")
    )


_BAND_SQL = """CASE WHEN employees IS NULL THEN 'missing' WHEN employees = 0 THEN '0' WHEN employees < 5 THEN '1-4'
  WHEN employees < 20 THEN '5-19' WHEN employees < 100 THEN '20-99' ELSE '100+' END"""
STRATA_SQL = f"""strata AS (
  SELECT *, concat(CASE WHEN legal_form IN ('AS', 'ASA', 'ENK') THEN legal_form ELSE 'OTHER' END, '|', {_BAND_SQL}, '|',
      CASE WHEN bankrupt OR liquidating THEN 'adverse' ELSE 'active' END, '|',
      CASE WHEN website IS NULL THEN 'no-web' ELSE 'web' END) AS stratum,
    concat(legal_form, '|', {_BAND_SQL}, '|', string_split(industry_code, '.')[1], '|', municipality_number[1:2], '|',
      CASE WHEN website IS NULL THEN 'no-web' ELSE 'web' END) AS filer_stratum
  FROM entity
)"""


@check("X17_strata", sql=b.with_ctes(b.ENTITY_SQL, STRATA_SQL, "SELECT org, stratum, filer_stratum FROM strata"))
def strata(spark: SparkSession, d: str) -> DataFrame:
    return b.entity(spark, d).select(
        "org",
        values.stratum(
            F.col("legal_form"), F.col("employees"), F.col("bankrupt") | F.col("liquidating"), F.col("website")
        ).alias("stratum"),
        values.filer_stratum(
            F.col("legal_form"), F.col("employees"), F.col("industry_code"), F.col("municipality_number"), F.col("website")
        ).alias("filer_stratum"),
    )


@check(
    "X18_change_wording",
    sql=b.with_ctes(
        b.CHANGE_SQL,
        """SELECT event_id, seq, CASE op WHEN 'remove' THEN concat(path, ' removed') WHEN 'add' THEN concat(path, ' added: ', value)
          ELSE concat(path, ' updated: ', value) END AS wording FROM change""",
    ),
)
def change_wording(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("path").alias("label"), F.col("op").alias("operation"), F.col("value").alias("value"))
    # The same change twice is one phrase.
    return b.change_rows(spark, d).select(
        "event_id", "seq", values.change_summary(F.array(item, item)).alias("wording")
    )


@check(
    "X19_path_labels",
    sql=b.with_ctes(
        b.CHANGE_SQL,
        """SELECT event_id, seq, CASE path WHEN '/antallAnsatte' THEN 'registered employee count'
          WHEN '/naeringskode1' THEN 'registered industry'
          WHEN '/forretningsadresse/adresse' THEN 'registered business address' END AS label FROM change""",
    ),
)
def path_labels(spark: SparkSession, d: str) -> DataFrame:
    return b.change_rows(spark, d).select("event_id", "seq", values.path_label(F.col("path")).alias("label"))


@check(
    "X20_phone_and_review_label",
    sql="""SELECT c_custkey, lpad(CAST(20000000 + c_custkey AS VARCHAR), 8, '0') AS phone,
      CASE c_custkey % 5 + 1 WHEN 1 THEN 'negative' WHEN 2 THEN 'negative' WHEN 3 THEN 'neutral' ELSE 'positive' END AS label
      FROM customer""",
)
def phone_and_review_label(spark: SparkSession, d: str) -> DataFrame:
    number = (F.col("c_custkey") + 20_000_000).cast("string")
    written = F.concat(F.lit("+47 "), number.substr(1, 2), F.lit(" "), number.substr(3, 6))
    return b.table(spark, d, "customer").select(
        "c_custkey",
        text.norwegian_phone(written).alias("phone"),
        values.review_label(F.pmod("c_custkey", F.lit(5)) + 1).alias("label"),
    )


@check(
    "X21_confidence",
    sql="""SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0 WHEN value IS NULL THEN 0.95
      ELSE greatest(0.0, least(1.0, value / 50)) END AS confidence FROM events""",
)
def confidence(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("available"))
    return b.table(spark, d, "events").select(
        "event_id", values.claim_confidence(state, F.col("value") / 50, F.lit("website")).alias("confidence")
    )


@check(
    "X22_source_class",
    sql="""SELECT DISTINCT source, CASE source WHEN 'src1' THEN 'official' WHEN 'src2' THEN 'company_owned' ELSE source END AS folded
      FROM documents""",
)
def folded_source_class(spark: SparkSession, d: str) -> DataFrame:
    source = F.col("source")
    named = (
        F.when(source == "src1", F.lit("Official_registry_bulk"))
        .when(source == "src2", F.lit("registry_linked_company_website"))
        .otherwise(source)
    )
    return b.table(spark, d, "documents").select("source", values.source_class(named).alias("folded")).distinct()


@check(
    "X23_percentages",
    sql="""SELECT source, round_even(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 1) AS english_pct, 0.0 AS empty_pct
      FROM documents GROUP BY source""",
)
def percentages(spark: SparkSession, d: str) -> DataFrame:
    return (
        b.table(spark, d, "documents")
        .groupBy("source")
        .agg(F.count_if(F.col("lang") == "en").alias("english"), F.count(F.lit(1)).alias("documents"))
        .select(
            "source",
            values.percentage(F.col("english"), F.col("documents")).alias("english_pct"),
            values.percentage(F.col("english"), F.lit(0)).alias("empty_pct"),
        )
    )


_SECTIONS = ("en", "fr", "de", "es")


@check(
    "X24_title_and_section",
    sql="""WITH p AS (SELECT page_id, list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS s,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
      SELECT page_id, coalesce(len(s) >= 2 AND list_contains(['en', 'fr', 'de', 'es'], s[-2]) AND NOT list_contains(['en', 'fr', 'de', 'es'], s[-1])
          OR (len(s) >= 3 AND len(list_filter(s[:-2], lambda x: list_contains(['en', 'fr', 'de', 'es'], x))) > 0
            AND NOT list_contains(['en', 'fr', 'de', 'es'], s[-1])), false) AS below_section,
        len(s) > 0 AND NOT (len(s) = 1 AND list_contains(['en', 'fr', 'de', 'es'], s[1])) AS not_root,
        len(regexp_extract_all(title, '[\\p{L}\\p{N}_\\-]+')) >= 2 AS specific FROM p""",
)
def title_and_section(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.table(spark, d, "pages").select(
        "page_id",
        web.detail_page(F.col("url"), _SECTIONS).alias("below_section"),
        web.non_root_page(F.col("url"), _SECTIONS).alias("not_root"),
        text.specific_title(title, ("nyheter",)).alias("specific"),
    )
