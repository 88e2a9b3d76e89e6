"""Annual-report text: workforce counts and business descriptions, with their observations and claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import json_value, material_id
from ..functions.orgnum import digits
from ..functions.staging import bound, with_stage
from ..functions.text import MARK, last_at_most, occurrences, running_totals, squash
from ..model import CLAIM, EVIDENCE, OBSERVATION, conform

# Wording of workforce numbers; lower priority numbers are stronger.
_NUMBER = r"((?-i:\b[0-9O][0-9O .,-]{0,8}))"
_FTE = r"(?:aarsverk|arsverk|årsverk)"
WORKFORCE_PATTERNS = (
    (0, "full_time_equivalents", r"(?iu)(?:antall|tal\s+p[aå])\s+" + _FTE + r"\s+i\s+(?:regnskapsaret|rekneskapsaret)\s*(?:er|:|=)?\s*" + _NUMBER),
    (0, "full_time_equivalents", r"(?iu)antall\s+" + _FTE + r"(?:\s+sysselsatt\s+i\s+regnskapsaret)?\s*(?:er|:|=)?\s*" + _NUMBER),
    (0, "full_time_equivalents", r"(?iu)selskapet\s+har(?:\s+[i1]\s+\d{4})?\s+sysselsatt\s+" + _NUMBER + r"\s+" + _FTE),
    (0, "full_time_equivalents", r"(?iu)selskapet\s+har\s+" + _NUMBER + r"\s+" + _FTE),
    (0, "full_time_equivalents", r"(?iu)antall\s+" + _FTE + r"\s+(?:sysselsatt|syssetsatt)\s+i\s+regnskapsaret\s*(?:er|:|=)?\s*" + _NUMBER),
    (1, "employees", r"(?iu)gjennomsnittlig(?:e)?\s+antall\s+ansatte(?:\s+i\s+regnskapsaret)?\s*(?:er|:|=)?\s*" + _NUMBER),
    (1, "employees", r"(?iu)antall\s+ansatte\s*(?:er|:|=)?\s*" + _NUMBER),
    (2, "employees", r"(?iu)" + _NUMBER + r"\s+(?:heltids)?ansatte\b"),
)
WORD_COUNTS = {"ingen": 0, "en": 1, "ett": 1, "to": 2, "tre": 3, "fire": 4, "fem": 5}
WORD_PATTERN = r"(?iu)\b(?:det\s+er|selskapet\s+har)\s+(ingen|en|ett|to|tre|fire|fem)\s+ansatte\b"
ZERO_PATTERN = (
    r"(?iu)\b(?:selskapet|stiftelsen|legatet|sameiet|det)\s+(?:har\s+ingen\s+(?:ansatte|" + _FTE + r")"
    r"|har\s+ikke\s+hatt\s+(?:noen\s+)?ansatte|hadde\s+ingen\s+ansatte|ikke\s+har\s+ansatte)\b"
)
GROUP_WORDS = r"(?i)konsern|group"
# Headings and reject rules of activity sections.
HEADINGS = (
    r"(?imu)^\s*(?:virksomhetens|verksemdas|selskapets|selskapets?)\s+(?:art|virksomhet|verksemd)\s*[:.-]?\s*$",
    r"(?imu)^\s*(?:om\s+)?(?:selskapet|verksemda)\s*[:.-]?\s*$",
)
STOP_HEADING = (
    r"(?imu)^\s*(?:fortsatt\s+drift|going\s+concern|arsresultat|årsresultat|resultat"
    r"|utvikling\s+i\s+resultat(?:et)?\s+og\s+(?:finansiell\s+)?stilling|okonomisk\s+utvikling|økonomisk\s+utvikling|balanse"
    r"|egenkapital|styret|hendelser|risiko|arbeidsmiljo|arbeidsmiljø|likestilling|miljo|miljø|redegjorelse|redegjørelse|noter?"
    r"|note\s+\d+|salgsinntekter|inntektsforing|inntektsføring|klassifisering\s+og\s+vurdering|anleggsmidler|omlopsmidler"
    r"|omløpsmidler|skatt|leieavtaler|fordringer|varelager|avskrivninger)\b.*$"
)
INLINE_STOP = (
    r"(?iu)(?<!^)\s+(?:utvikling\s+i\s+resultat(?:et)?\s+og\s+(?:finansiell\s+)?stilling|okonomisk\s+utvikling|økonomisk\s+utvikling"
    r"|salgsinntekter|inntektsforing|inntektsføring|klassifisering\s+og\s+vurdering(?:\s+av\s+balanseposter)?|anleggsmidler"
    r"|omlopsmidler|omløpsmidler|leieavtaler|fordringer|varelager|avskrivninger|skatt(?:ekostnad(?:en)?)?)\b"
)
GROUP_ONLY = r"(?iu)\b(?:konsernet|konsernets|the\s+group|group\s+activities)\b"
COMPANY_SCOPE = r"(?iu)\b(?:selskapet|virksomheten|verksemda|foretaket|company)\b"
BOILERPLATE = (
    r"(?iu)\b(?:arsregnskapet\s+er\s+avlagt|årsregnskapet\s+er\s+avlagt|regnskapet\s+er\s+utarbeidet|accounting\s+principles)\b"
)
POLICY_ONLY = (
    r"(?iu)\b(?:har\s+(?:ikke\s+)?endret\s+regnskapsprinsipp|regnskapsprinsipp(?:er|ene)?|accounting\s+polic(?:y|ies)"
    r"|prinsippendring)\b"
)
FINANCING = (
    r"(?iu)\b(?:investor(?:er|en)?|kapitalinnhenting|kapitaltilforsel|kapitaltilførsel|finansiering|refinansiering|likviditet"
    r"|egenkapitaltilforsel|egenkapitaltilførsel)\b"
)
ACTIVITY = (
    r"(?iu)\b(?:salg|selge|kjop|kjøp|import|eksport|produksjon|produsere|utvikl(?:er|ing|e)|lever(?:er|ing|e)|tjenest(?:e|er)"
    r"|konsulent|radgiv|rådgiv|programvare|it\b|bygg|anlegg|tomrer|tømrer|oppforing|oppføring|utleie|eiendom|handel|butikk"
    r"|transport|logistikk|servering|restaurant|overnatting|turist|fiske|kunst|kurs|konfeksjonering|investering(?:er)?|aksjer"
    r"|andeler|eie|oppdrett|drift|driver|virksomhet|verksemd|tannlege|helse|behandling|engineering|consulting)\b"
)
LEADING_ENTITY = r"^\s*([A-ZÆØÅ0-9][A-Za-zÆØÅæøå0-9&.'’()\-/ ]{1,80}?\s+(?:ASA|AS|ANS|DA|NUF|SA|BA|KS|IKS|HF|KF|SF))\b"
ENTITY_SUFFIX = r"(?iu)\s+(?:ASA|AS|ANS|DA|NUF|SA|BA|KS|IKS|HF|KF|SF)\s*$"


def report_number(raw: Column) -> Column:
    """Number of 0 to 100,000 as written in scanned reports; letters O read as zeros."""
    clean = F.regexp_replace(F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit("O"), F.lit("0")), r"^[.,\-]+|[.,\-]+$", "")
    plain = (
        F.when(F.contains(clean, F.lit(",")), F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(clean.rlike(r"\.\d{1,2}$"), clean)
        .otherwise(F.replace(clean, F.lit("."), F.lit("")))
    )
    number = plain.try_cast("double")
    return F.when(number.between(0, 100_000), F.bround(number, 2))


def workforce_candidates(text: Column) -> Column:
    """All workforce numbers of a report text as (priority, value, span, measure); lines about a group do not count.

    A span is the line or lines that a match lies on, found by halving in the starts of all lines.
    """
    def found_in(lines: Column, starts: Column) -> Column:
        def span(hit: Column) -> Column:
            first, last = last_at_most(starts, hit["start"]), last_at_most(starts, hit["start"] + F.length(hit["written"]))
            return F.trim(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n"))

        def rows(pattern: str, priority: int, value: Callable[[Column], Column], measure: Callable[[Column], Column]) -> Column:
            return F.transform(
                occurrences(text, pattern),
                lambda hit: F.struct(
                    F.lit(priority).alias("priority"), value(hit["written"]).alias("value"), span(hit).alias("span"), measure(hit["written"]).alias("measure")
                ),
            )

        def number(pattern: str) -> Callable[[Column], Column]:
            return lambda written: report_number(F.regexp_extract(written, pattern, 1))

        def named(measure: str) -> Callable[[Column], Column]:
            return lambda _: F.lit(measure)

        words = F.create_map(*[F.lit(item) for pair in WORD_COUNTS.items() for item in (pair[0], float(pair[1]))])
        years = lambda written: F.when(written.rlike("(?i)verk"), F.lit("full_time_equivalents")).otherwise(F.lit("employees"))
        return F.concat(
            *[rows(pattern, priority, number(pattern), named(measure)) for priority, measure, pattern in WORKFORCE_PATTERNS],
            rows(WORD_PATTERN, 2, lambda written: words[F.lower(F.regexp_extract(written, WORD_PATTERN, 1))], named("employees")),
            rows(ZERO_PATTERN, 0, lambda _: F.lit(0.0), years),
        )

    def by_lines(lines: Column) -> Column:
        return bound(running_totals(F.transform(lines, lambda line: F.length(line) + 1)), lambda starts: found_in(lines, starts))

    found = bound(F.split(F.replace(text, F.lit(MARK), F.lit(" ")), "\n", -1), by_lines)
    usable = F.filter(found, lambda item: item["value"].isNotNull() & ~item["span"].rlike(GROUP_WORDS))
    # Every pattern holds one of these words, so all other texts are done after one cheap search.
    speaks = text.rlike(r"(?iu)ansatte|aarsverk|arsverk|årsverk")
    none = F.array().cast("array<struct<priority:int,value:double,span:string,measure:string>>")
    return F.when(speaks, usable).otherwise(none)


def extract_workforce(reports: DataFrame) -> DataFrame:
    """Reports with the strongest workforce number, or the reason for abstaining. Input column: text."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\t\r ]+", " ")
    rows = with_stage(with_stage(reports, "_body", body), "_all", workforce_candidates(F.col("_body")))
    rows = with_stage(rows, "_first", F.array_min(F.transform("_all", lambda item: item["priority"])))
    rows = with_stage(rows, "_best", F.filter("_all", lambda item: item["priority"] == F.col("_first")))
    values = F.array_distinct(F.transform("_best", lambda item: item["value"]))
    full_time = F.filter("_best", lambda item: item["measure"] == "full_time_equivalents")
    chosen = F.coalesce(F.try_element_at(full_time, F.lit(1)), F.try_element_at("_best", F.lit(1)))
    status = (
        F.when(F.size("_all") == 0, F.lit("no_employee_phrase"))
        .when(F.size(values) > 1, F.lit("conflicting_employee_counts"))
        .otherwise(F.lit("accepted"))
    )
    pick = F.when(status == "accepted", chosen)
    return rows.select(
        *reports.columns, status.alias("workforce_status"), pick["value"].alias("workforce_value"), pick["span"].alias("workforce_span"),
        pick["measure"].alias("workforce_measure"),
    )


def needs_ocr(text: Column) -> Column:
    """Too little text, or none that speaks of staff."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 100) | ~F.coalesce(text, F.lit("")).rlike(
        r"(?iu)ansatt|aarsverk|arsverk|årsverk|sysselsatt"
    )


# --- W14 ---------------------------------------------------------------------------------------------

def _clean_section(section: Column) -> Column:
    lines = F.transform(F.split(section, "\n"), lambda line: F.regexp_replace(line, r"^[ \-•\t]+|[ \-•\t]+$", ""))
    flat = squash(F.array_join(F.filter(lines, lambda line: line != ""), " "))
    stop = F.regexp_instr(flat, F.lit(INLINE_STOP))
    cut = F.concat(F.regexp_replace(F.substring(flat, F.lit(1), stop - 1), r"[ .;:\-]+$", ""), F.lit("."))
    return F.when(stop > 40, cut).otherwise(flat)


def extract_description(reports: DataFrame) -> DataFrame:
    """Reports with the business description of the company itself, or the reason for abstaining."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r", "\n")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    rows = with_stage(reports, "_body", body)
    starts = F.flatten(
        F.array(
            *[
                F.transform(occurrences(F.col("_body"), heading), lambda hit: hit["start"] + F.length(hit["written"]))
                for heading in HEADINGS
            ]
        )
    )
    sections = F.transform(
        starts,
        lambda start: _clean_section(
            F.element_at(F.split(F.substring(F.col("_body"), start + 1, F.length("_body")), STOP_HEADING, 2), 1)
        ),
    )
    usable = F.filter(
        sections,
        lambda text: (F.length(text) >= 40)
        & ~text.rlike(POLICY_ONLY)
        & ~text.rlike(BOILERPLATE)
        & ~(text.rlike(FINANCING) & ~text.rlike(ACTIVITY))
        & ~(text.rlike(GROUP_ONLY) & ~text.rlike(COMPANY_SCOPE)),
    )
    # The shortest section of at most 450 characters comes first.
    ordered = F.array_sort(
        F.transform(usable, lambda text: F.struct((F.length(text) > 450).alias("long"), F.length(text).alias("n"), text.alias("text")))
    )
    rows = with_stage(rows, "description", F.try_element_at(ordered, F.lit(1))["text"])
    status = (
        F.when(F.col("_body") == "", F.lit("empty_text"))
        .when(F.col("description").isNull(), F.lit("no_company_activity_section"))
        .otherwise(F.lit("accepted"))
    )
    return rows.select(*reports.columns, "description", status.alias("description_status"))


def _plain_name(name: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), ENTITY_SUFFIX, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^0-9a-zæøå]+", " "))


def names_other_company(description: Column, target: Column) -> Column:
    """A description that opens with the legal name of another company."""
    named = F.regexp_extract(F.coalesce(description, F.lit("")), LEADING_ENTITY, 1)
    seen, wanted = _plain_name(named), _plain_name(target)
    fits = (seen == wanted) | F.contains(seen, wanted) | F.contains(wanted, seen)
    return (named != "") & ~(fits & (seen != "") & (wanted != ""))


# --- P5: observations ------------------------------------------------------------------------------------

def _proof(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.create_map(F.lit("type"), F.lit(kind), F.lit("value"), value) for kind, value in pairs])


def holds_number(text: Column, number: Column) -> Column:
    """A text writes a number: its digits in order with at most three signs or blanks between two of them, and no digit next to them.

    Digits of separate numbers, or with words between them, do not make one.
    """
    spread = F.regexp_replace(number, "(?<=[0-9])(?=[0-9])", r"[^0-9\\p{L}]{0,3}")
    # Most texts without the number are done after the plain search.
    return F.contains(digits(text), number) & F.regexp_like(text, F.concat(F.lit("(?<![0-9])"), spread, F.lit("(?![0-9])")))


def _own_reports(reports: DataFrame) -> DataFrame:
    """Reports whose text holds the target number, with a full hash."""
    return reports.filter(
        F.col("org").rlike("^[0-9]{9}$") & holds_number(F.col("text"), F.col("org"))
        & (F.length(F.coalesce("content_sha256", F.lit(""))) == 64)
    )


def workforce_observations(reports: DataFrame, known: DataFrame) -> DataFrame:
    """Workforce observations of reports of companies that have none yet.

    ``reports``: org, text, source_url, content_sha256, retrieved_at, effective_at; ``known``: observations.
    """
    have = known.filter(F.col("signal_type") == "workforce_snapshot").select("org")
    rows = extract_workforce(_own_reports(reports.join(have, "org", "left_anti"))).filter(F.col("workforce_status") == "accepted")
    whole = F.col("workforce_value") == F.floor("workforce_value")
    value = F.when(whole, F.col("workforce_value").cast("bigint").cast("string")).otherwise(F.col("workforce_value").cast("string"))
    observations = rows.select(
        material_id("annual-workforce-", 24, F.col("org"), F.col("effective_at"), value, F.col("content_sha256")).alias("id"),
        "org", F.lit("brreg").alias("platform"), F.lit("workforce_snapshot").alias("signal_type"), "source_url", "retrieved_at",
        "content_sha256", F.lit(True).alias("exact_entity"),
        _proof(
            ("official_brreg_annual_account_endpoint_organisation_number", F.col("org")),
            ("organisation_number_in_report_text", F.col("org")),
        ).alias("identity_proof"),
        F.lit("official_api").alias("acquisition_mode"), F.lit("approved").alias("rights_status"),
        F.lit("official_annual_account_copy").alias("source_class"), F.col("workforce_span").alias("evidence_span"), "effective_at",
        F.create_map(
            F.lit("workforce_value"), value, F.lit("measure"), F.col("workforce_measure"), F.lit("scope"), F.lit("legal_entity")
        ).alias("metrics"),
        F.lit("annual_report_workforce_snapshot").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


def description_observations(reports: DataFrame, entities: DataFrame) -> DataFrame:
    """Description observations; the description itself is the evidence span."""
    rows = extract_description(_own_reports(reports)).filter(F.col("description_status") == "accepted")
    named = rows.join(entities.select("org", "name"), "org").filter(~names_other_company(F.col("description"), F.col("name")))
    observations = named.select(
        material_id("annual-description-", 24, F.col("org"), F.col("effective_at"), F.col("description"), F.col("content_sha256")).alias("id"),
        "org", F.lit("brreg").alias("platform"), F.lit("company_profile").alias("signal_type"), "source_url", "retrieved_at",
        "content_sha256", F.lit(True).alias("exact_entity"),
        _proof(
            ("official_brreg_annual_account_endpoint_organisation_number", F.col("org")),
            ("organisation_number_in_report_text", F.col("org")),
        ).alias("identity_proof"),
        F.lit("official_api").alias("acquisition_mode"), F.lit("approved").alias("rights_status"),
        F.lit("official_annual_account_copy").alias("source_class"), F.col("description").alias("evidence_span"), "effective_at",
        F.create_map(F.lit("company_description"), F.col("description")).alias("metrics"),
        F.lit("annual_report_company_description_exact_org_v3").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


# --- P6: claims -----------------------------------------------------------------------------------------------

def _official_evidence(rows: DataFrame) -> DataFrame:
    return conform(
        rows.select(
            "org", F.col("_evidence_id").alias("id"), "source_url", F.lit("official").alias("source_class"), "retrieved_at",
            "content_sha256", F.col("evidence_span").alias("claim_span"), "effective_at",
        ),
        EVIDENCE,
    )


def workforce_claims(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One claim per validated workforce observation with a non-negative value."""
    rows = observations.filter(
        F.col("publishable") & (F.col("signal_type") == "workforce_snapshot")
        & (F.col("metrics")["workforce_value"].try_cast("double") >= 0)
    ).withColumn(
        "_evidence_id", material_id("ev-workforce-", 20, F.col("org"), F.col("id"), F.col("source_url"), F.col("content_sha256"))
    )
    value = F.concat(
        F.lit('{"measure":'), F.coalesce(json_value(F.col("metrics")["measure"]), F.lit("null")), F.lit(',"scope":'),
        F.coalesce(json_value(F.col("metrics")["scope"]), F.lit("null")), F.lit(',"value":'), F.col("metrics")["workforce_value"], F.lit("}"),
    )
    claims = rows.select(
        "org", F.concat_ws("|", F.lit("86"), "platform", "id").alias("claim_order"),
        F.lit("external.workforce_snapshot").alias("field"), value.alias("value"), F.lit("available").alias("availability"),
        F.lit(1.0).alias("confidence"), F.array("_evidence_id").alias("evidence_ids"), "platform",
        F.lit("workforce_snapshot").alias("signal_type"), F.col("id").alias("observation_id"),
    )
    return conform(claims, CLAIM), _official_evidence(rows)


def annual_description_claims(claims: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Description claims for companies without one, where all report descriptions agree."""
    described = claims.filter(
        (F.col("field") == "company_description") & (F.col("availability") == "available")
    ).select("org")
    text = F.trim(F.col("metrics")["company_description"])
    rows = observations.filter(
        F.col("publishable") & (F.col("signal_type") == "company_profile") & (F.col("platform") == "brreg") & (F.length(text) >= 40)
    ).withColumn("_text", text)
    rest = F.struct("id", "source_url", "retrieved_at", "content_sha256", "evidence_span", "effective_at", "_text")
    agreed = rows.groupBy("org").agg(F.min("_text").alias("_a"), F.max("_text").alias("_b"), F.min_by(rest, F.col("id")).alias("_row"))
    picked = (
        agreed.filter(F.col("_a") == F.col("_b"))
        .join(described, "org", "left_anti")
        .select("org", "_row.*")
        .withColumn(
            "_evidence_id",
            material_id(
                "ev-annual-description-", 20, F.col("org"), F.col("id"), F.col("source_url"), F.col("content_sha256"), F.col("_text")
            ),
        )
    )
    new_claims = picked.select(
        "org", F.lit("87|000000").alias("claim_order"), F.lit("company_description").alias("field"),
        json_value(F.col("_text")).alias("value"), F.lit("available").alias("availability"), F.lit(1.0).alias("confidence"),
        F.array("_evidence_id").alias("evidence_ids"), F.lit("brreg").alias("platform"),
        F.lit("company_profile").alias("signal_type"), F.col("id").alias("observation_id"),
    )
    return conform(new_claims, CLAIM), _official_evidence(picked)
