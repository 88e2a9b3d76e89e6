"""Findings of round 4: each test failed before its commit."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmledger.functions.text import all_text_dates, first_text_date
from firmledger.operators import reach, reports


def test_numbers_of_other_lines_do_not_make_the_own_number(spark):
    texts = {
        "1": "Antall ansatte er 78000\nAntall årsverk: 78000",  # joined digits hold 800078000
        "2": "Foretak 800078000", "3": "NO 800 078 000 MVA", "4": "org.nr. 800.078\n000", "5": "8 0 0 0 7 8 0 0 0",
        "6": "8000780001", "7": "7800078000", "8": "800 ansatte 078 000", "9": "",
    }
    rows = spark.createDataFrame([(key, text, "800078000") for key, text in texts.items()], "key string, text string, org string")
    got = {row["key"] for row in rows.filter(reports.holds_number(F.col("text"), F.col("org"))).collect()}
    assert got == {"2", "3", "4", "5"}


def test_digits_of_a_hexadecimal_word_are_no_number(spark):
    texts = [
        (1, "password=13c62e6ad800000001a3"), (2, "token 4f800a000b001c22"), (3, "a1bc800000001 ends"), (4, "800000001ab45"),
        (5, "id800000001"), (6, "800 000 001 a4"), (7, "NO800.000.001MVA"), (8, "f800000001 og c"), (9, "800--000 001."),
    ]
    rows = spark.createDataFrame(texts, "key int, text string")
    targets = spark.createDataFrame([("800000001",)], "org string")
    got = reach.raw_occurrences(rows, "key", "text", targets).collect()
    assert sorted((row["text_key"], row["position"]) for row in got) == [(5, 2), (6, 0), (7, 2), (8, 1), (9, 0)]


def test_part_of_a_dotted_address_is_no_date(spark):
    rows = spark.createDataFrame([(1, "05.02.2024 fra 21.29.12.35 i dag"), (2, "15.01.24-16.01.24"), (3, "Den 1.2.2024."), (4, "v 1.1.12.20")], "key int, text string")
    got = {row["key"]: (row["first"], row["all"]) for row in rows.select(
        "key", first_text_date(F.col("text")).alias("first"), all_text_dates(F.col("text")).alias("all")).collect()}
    assert got == {
        1: ("2024-02-05", ["2024-02-05"]), 2: ("2024-01-15", ["2024-01-15", "2024-01-16"]), 3: ("2024-02-01", ["2024-02-01"]), 4: (None, []),
    }


def test_headline_mentions_are_pairs_of_companies_and_headlines(spark):
    from firmledger.checks.registry import all_sql
    from firmledger.operators import matching

    assert "SELECT DISTINCT n.org, doc_id" in all_sql()["J15_headline_mentions"]
    names = spark.createDataFrame([("1", "Fjord Fisk"), ("2", "Fjord Fisk"), ("3", "Fisk"), ("3", "Fjord Fisk"), ("4", "Annet")], "org string, name string")
    headlines = spark.createDataFrame([(7, "Fjord Fisk vokser - Avisen"), (8, "Fisk fra nord - Avisen")], "key int, title string")
    got = matching.headline_mentions(names, headlines, "key", "title")
    assert sorted((row["org"], row["key"]) for row in got.collect()) == [("1", 7), ("2", 7), ("3", 7), ("3", 8)]


def test_evidence_is_read_without_being_stored(spark, monkeypatch):
    from firmledger.checks import claims
    from firmledger.model import CLAIM, EVIDENCE, empty
    from firmledger.operators import claims as c

    texts = (*c._RECORD, "claim_order", "evidence_key", "field", "value", "state", "claim_span", "currency", "reporting_period", "org")
    drafts = spark.createDataFrame(
        [(*["x"] * len(texts), 1.0)], ", ".join(f"{name} string" for name in texts) + ", identity_score double"
    ).withColumn("state", F.lit("available"))
    made = []
    monkeypatch.setattr(claims, "stored", lambda session, d, name, build: made.append(name) or c.settled_drafts(drafts))
    monkeypatch.setattr(claims, "_families", lambda *_: [("award", F.col("field") == "y", (empty(spark, CLAIM), empty(spark, EVIDENCE)))])
    assert claims.evidence_rows(spark, "none").count() == 1 and made == ["base-claims"]


def test_replaced_evidence_is_that_of_replaced_claims(spark):
    from firmledger.model import CLAIM, EVIDENCE, conform
    from firmledger.operators import claims as c

    texts = (*c._RECORD, "claim_order", "evidence_key", "field", "value", "state", "claim_span", "currency", "reporting_period", "org")
    rows = [("a", "1", "s1"), ("a", "2", "s2"), ("b", "3", "s3"), ("c", "4", "s4"), ("c", "5", "s5"), ("d", "6", "s6")]
    drafts = spark.createDataFrame(
        [(*["x"] * len(texts), 1.0, *row) for row in rows], ", ".join(f"{name} string" for name in texts) + ", identity_score double, f string, o string, s string"
    ).select(*[name for name in (*texts, "identity_score") if name not in ("field", "claim_order", "claim_span", "state")],
             F.col("f").alias("field"), F.col("o").alias("claim_order"), F.col("s").alias("claim_span"), F.lit("available").alias("state"))
    settled = c.settled_drafts(drafts)
    claims, evidence = c.split_settled(settled)
    fresh = claims.filter("field = 'd'").select(F.explode("evidence_ids").alias("id"))
    new = conform(fresh.select(F.lit("x").alias("org"), "id", F.lit("new").alias("claim_span")).unionByName(
        spark.createDataFrame([("x", "n1", "added")], "org string, id string, claim_span string")), EVIDENCE)
    for managed in (F.col("field") == "b", F.col("field") == "none"):
        want = c.replace_managed(claims, evidence, managed, claims.filter("false"), new)[1]
        got = c.replaced_evidence(settled, managed, new, lambda frame: frame.withColumn("_long", F.length("claim_span") > 2))
        assert sorted(map(str, want.collect())) == sorted(map(str, got.select(*EVIDENCE.fieldNames()).collect()))
    assert {row["claim_span"] for row in got.collect()} == {"s2", "s3", "s5", "new", "added"} and got.filter("_long").count() == 2
    assert claims.columns == CLAIM.fieldNames()


def test_missing_texts_of_a_brief_are_found_in_one_pass(spark):
    from firmledger.operators import serving

    names = (*serving.QUESTIONS, "section_company", "section_financials", "section_organisation", "section_external")
    briefs = spark.createDataFrame([("1", *["t"] * len(names)), ("2", "", None, *["t"] * (len(names) - 2))], "org string, " + ", ".join(f"{n} string" for n in names))
    traces = spark.createDataFrame([], "org string, question string, evidence_id string, source_url string, retrieved_at string, claim_span string, content_sha256 string")
    evidence = spark.createDataFrame([], "org string, id string, source_url string, retrieved_at string, claim_span string, content_sha256 string")
    found = serving.brief_violations(briefs, traces, evidence)
    assert sorted((r["org"], r["subject"]) for r in found.collect()) == sorted([("2", names[0]), ("2", names[1])])
    # One reading of the briefs, not one per text.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("section_external#") <= 3


def test_award_provenance_reads_the_evidence_once(spark):
    from firmledger.model import CLAIM, EVIDENCE, conform
    from firmledger.operators import awards, provenance

    schema = "org string, id string, source_url string, source_class string, content_sha256 string, source_row_key string, extraction_method string, identity_proof string"
    url, sha = awards.AWARD_SOURCE_URL, "a" * 64
    rows = [
        ("1", "a", url, "official", sha, "r", None, "p"), ("1", "b", url, "official", sha, "", None, None), ("1", "c", url, "official", sha, "r", "own", None),
        ("1", "d", url, "official", sha, "r", "", None), ("2", "a", url, "official", sha, "r", None, None), ("1", "e", "x", "official", sha, "r", None, None),
    ]
    evidence = conform(spark.createDataFrame(rows, schema), EVIDENCE)
    claims = conform(spark.createDataFrame([("1", ["a", "b", "c", "e"])], "org string, evidence_ids array<string>").withColumns({
        "field": F.lit(awards.AWARD_FIELD), "availability": F.lit("available"), "platform": F.lit("brreg"), "signal_type": F.lit(awards.AWARD_SIGNAL),
        "claim_scope": F.lit(awards.AWARD_SCOPE)}), CLAIM)
    filled = provenance.award_provenance(claims, evidence)
    got = {(r["org"], r["id"]): (r["extraction_method"], r["identity_proof"]) for r in filled.collect()}
    named = awards.AWARD_EXTRACTION_METHOD
    assert got[("1", "a")] == (named, "p") and got[("1", "c")][0] == "own" and not any(got[key][0] for key in [("1", "b"), ("1", "d"), ("2", "a"), ("1", "e")])
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
