"""Small hand-written cases for rules that the test tables do not reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from firmledger.functions import orgnum, text, values, web
from firmledger.functions.ids import variant_json
from firmledger.operators import activity, identity, reports, site_surface
from firmledger.operators.cohorts import profiles_for_manifest
from firmledger.functions.text import occurrences
from firmledger.operators.serving import screen
from firmledger.session import checkpoint, session_checkpoint_dir
from firmledger.sources.awards import detect_encoding, read_award_rows, resolve_headers
from firmledger.sources.pages import page_events
from firmledger.sources.registry import read_manifest, read_registry_bulk


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("number", "ok"), [("974760673", True), ("974760674", False), ("97476067", False), ("", False)]
)
def test_check_digit(spark, number, ok):
    assert value(spark, orgnum.has_valid_check_digit(F.lit(number))) is ok


def test_numbers_in_text(spark):
    body = F.lit("NO 974 760 673 MVA, 974.760.673 og 1974760673, org.nr: 123 456 789")
    assert value(spark, orgnum.extract_org_numbers(body)) == ["974760673"]
    assert sorted(value(spark, orgnum.extract_labelled_org_numbers(body))) == ["123456789", "974760673"]


def test_fold(spark):
    assert value(spark, text.fold(F.lit("Ærø Ålesund Café ĳ №"))) == "aero alesund cafe ij "


@pytest.mark.parametrize(
    ("raw", "amount"), [("1.234,50", "1234.500000"), ("1,234.50", "1234.500000"), ("12,5", "12.500000"), ("kr 7", "7.000000"), ("-", None)]
)
def test_amounts(spark, raw, amount):
    found = value(spark, text.parse_amount(F.lit(raw)))
    assert (None if found is None else str(found)) == amount


@pytest.mark.parametrize(
    ("raw", "day"), [("2024-02-30", None), ("3.1.2024", "2024-01-03"), ("03/01/2024", "2024-01-03"), ("3-1-2024", "2024-01-03")]
)
def test_award_dates(spark, raw, day):
    assert value(spark, text.parse_award_date(F.lit(raw)).cast("string")) == day


def test_half_even_percentage(spark):
    assert value(spark, values.percentage(F.lit(1), F.lit(8))) == 12.5
    assert value(spark, values.percentage(F.lit(3), F.lit(0))) == 0.0


def test_registry_value_wording(spark):
    assert value(spark, values.render_registry_value(F.lit('{"kode":"47.1","beskrivelse":"Handel"}'))) == "Handel (47.1)"
    assert value(spark, values.render_registry_value(F.lit('["a","b","c","d","e"]'))) == "a, b, c, d, e"
    assert value(spark, values.render_registry_value(F.lit(None).cast("string"))) == "removed"


def test_registered_domain(spark):
    assert value(spark, web.registered_domain(F.lit("https://www.post.firma.no/x"))) == "firma.no"
    assert value(spark, web.registered_domain(F.lit("https://a.oslo.kommune.no"))) == "oslo.kommune.no"


def test_links_resolve(spark):
    base = F.lit("https://a.no/om/oss?x=1")
    assert value(spark, web.resolve_link(base, F.lit("../b"))) == "https://a.no/b"
    assert value(spark, web.resolve_link(base, F.lit("./c/../../../d/.?q=1/../2"))) == "https://a.no/d/?q=1/../2"
    assert value(spark, web.resolve_link(base, F.lit("/b"))) == "https://a.no/b"
    assert value(spark, web.resolve_link(base, F.lit("//c.no/d"))) == "https://c.no/d"


def test_careers_words_are_whole_words(spark):
    terms = site_surface.CAREERS_PATH_TERMS
    assert value(spark, site_surface.phrase_rank(F.lit(" ledige stillinger "), terms)) is not None
    assert value(spark, site_surface.phrase_rank(F.lit("minkarriereside"), terms)) is None


def test_canonical_json_sorts_at_every_depth(spark):
    assert value(spark, variant_json(F.lit('{"b":{"d":1,"c":null},"a":[2]}'))) == '{"a":[2],"b":{"c":null,"d":1}}'


def test_missing_company_is_explicit(spark):
    manifest = spark.createDataFrame([("974760673",), ("999999999",)], "org string")
    entities = spark.createDataFrame([("974760673", "A", "AS", "2025")], "org string, name string, legal_form string, latest_submitted_accounts string")
    rows = {row["org"]: row["registry_status"] for row in profiles_for_manifest(manifest, entities).collect()}
    assert rows == {"974760673": "available", "999999999": "not_found"}


def test_page_identity_ladder(spark):
    entities = spark.createDataFrame([("974760673", "Nordlys Maskin AS", "Bergen")], "org string, name string, municipality string")
    schema = (
        "org string, site_id string, final_url string, registered_domain string, title string, description string,"
        " identity_text string, main_text string, structured_names array<string>"
    )

    def page(key, title="", identity_text="", main=""):
        return ("974760673", key, "https://a.no/", "a.no", title, "", identity_text, main, [])

    pages = [
        page("name", title="Nordlys Maskin"), page("own", identity_text="Org.nr 974 760 673"), page("other", identity_text="Org.nr: 123456789"),
        page("parked", main="This domain is for sale"), page("none", main="Velkommen"),
        page("owner", identity_text="Dette nettstedet eies av Annet Firma AS", title="Nordlys Maskin"),
    ]
    assessed = identity.assess_sites(identity.site_features(entities, spark.createDataFrame(pages, schema)))
    scores = {row["site_id"]: row["score"] for row in assessed.collect()}
    assert scores == {"name": 0.95, "own": 1.0, "other": 0.1, "parked": 0.1, "none": 0.3, "owner": 0.1}


def test_workforce_conflict_and_group(spark):
    texts = [("Antall årsverk: 12",), ("Antall årsverk: 12\nAntall årsverk er 13",), ("Konsernet har antall ansatte: 9",), ("Selskapet har ingen ansatte",)]
    rows = reports.extract_workforce(spark.createDataFrame(texts, "text string")).collect()
    assert [(row["workforce_status"], row["workforce_value"]) for row in rows] == [
        ("accepted", 12.0), ("conflicting_employee_counts", None), ("no_employee_phrase", None), ("accepted", 0.0),
    ]


def test_employer_match(spark):
    match = activity.employer_matches(F.lit("Nordlys Maskin AS"), F.lit(""), F.lit("Selger hos Maskin Nordlys i Bergen"))
    assert value(spark, match) is True
    assert value(spark, activity.employer_matches(F.lit("Nordlys Maskin AS"), F.lit("Nordlys Eiendom"), F.lit("Nordlys Maskin"))) is False


def test_award_file_in_utf16(spark, tmp_path):
    path = tmp_path / "awards.csv"
    body = "Organisasjonsnummer støttemottaker;Spesifisert mottaker organisasjonsnummer;Tildelingsdato;Tildelt beløp\n974760673;;01.02.2024;\"1.000,50\"\n"
    path.write_bytes(body.encode("utf-16"))
    assert detect_encoding(path.read_bytes()[:4]) == "UTF-16"
    rows = read_award_rows(spark, str(path))
    assert resolve_headers(rows.columns)["recipient"] == "Organisasjonsnummer støttemottaker"
    assert rows.count() == 1


def test_registry_file_and_manifest(spark, tmp_path):
    path = tmp_path / "units.csv"
    path.write_text("﻿Organisasjonsnummer;Navn;Antall ansatte;Konkurs\n974760673;Nordlys;x;TRUE\n1;Kort;2;false\n", encoding="utf-8")
    row = read_registry_bulk(spark, str(path)).collect()
    assert [(r["org"], r["employees"], r["bankrupt"]) for r in row] == [("974760673", None, True)]
    manifest = tmp_path / "orgs.txt"
    manifest.write_text("974 760 673\n", encoding="utf-8")
    assert [r["org"] for r in read_manifest(spark, str(manifest)).collect()] == ["974760673"]
    manifest.write_text("974760673\n974760673\n", encoding="utf-8")
    with pytest.raises(ValueError, match="duplicate"):
        read_manifest(spark, str(manifest))


def test_screen_abstains(spark):
    frame = spark.createDataFrame([("1", "A")], "org string, name string")
    with pytest.raises(ValueError, match="not qualified"):
        screen(frame, [("name", "eq", "a")], unsupported=("sentiment",))


def test_checkpoint_folder_is_read_not_replaced(spark):
    first = session_checkpoint_dir(spark)
    assert session_checkpoint_dir(spark) == first
    assert checkpoint(spark.range(3)).count() == 3


def test_hostile_page_is_a_row(spark):
    deep = "[" * 200_000 + "]" * 200_000
    pages = [("1", f'<script type="application/ld+json">{deep}</script><p>kept</p>'), ("2", "<div>" * 20_000 + "text"), ("3", None)]
    rows = spark.createDataFrame(
        [(org, "u", f"https://a{org}.no/", 200, "text/html", "home", None, html) for org, html in pages],
        "org string, requested_url string, final_url string, status_code int, content_type string, page_kind string, retrieved_at timestamp, html string",
    )
    got = {row["org"]: row for row in page_events(rows).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"]["status"] in ("available", "source_error")


def test_mark_character_in_text_is_no_number(spark):
    rows = spark.createDataFrame([("x\u0001y Antall ansatte er 12",)], "text string")
    starts = rows.select(occurrences(F.col("text"), r"\d+").alias("found")).first()["found"]
    assert [row["written"] for row in starts] == ["12"]
