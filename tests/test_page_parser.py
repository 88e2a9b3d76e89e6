"""The page parser: ranges, dates, identity texts, cards, and size and time that grow with the page."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from firmledger.operators import seeds, site_surface
from firmledger.sources import pages
from firmledger.sources.pages import _parse

SCHEMA = "org string, requested_url string, final_url string, status_code int, content_type string, page_kind string, retrieved_at string, html string"


def snapshot(spark, *bodies):
    rows = [(str(k), "https://a.no/", "https://a.no/", 200, "text/html", "homepage", "2024-02-01T00:00:00Z", html) for k, html in enumerate(bodies)]
    return pages.page_events(spark.createDataFrame(rows, SCHEMA))


def cards(spark, html):
    found = snapshot(spark, html)
    rows = site_surface.job_cards(pages.page_links(found), found).orderBy("pick").collect()
    return [(r.title, r.role_url.removeprefix("https://a.no"), r.deadline_raw, r.application_url.removeprefix("https://a.no"), r.employer_context) for r in rows]


@pytest.mark.parametrize("tag", ["<div>", "<li>", "<p>", "<b><a href='/x'>", "<div class='date'>", "</div>", "<td>"])
def test_unclosed_and_stray_tags_take_time_in_proportion(tag):
    took = []
    for many in (5_000, 40_000):
        began = time.process_time()
        assert _parse(tag * many + "x")["main_text"] == "x"
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 1  # eight times the page


def test_cards_of_many_links_do_not_repeat_their_text():
    sizes = []
    for many in (500, 4_000):
        found = _parse("<div>" + "".join(f'tekst <a href="/{k}">lenke {k}</a> 1.1.2024' for k in range(many)) + "</div>")
        sizes.append(sum(len(str(value)) for value in found.values()))
        assert len(found["links"]) == many
    assert sizes[1] < 12 * sizes[0]


def test_implied_ends():
    found = _parse("<ul><li>en<ul><li>to<li>tre</ul><li>fire <a href='/a'>A</a></ul><table><tr><td>x<td><a href='/b'>B</a><tr><td>y</table>")
    assert found["main_text"] == "en to tre fire A x B y"
    assert [link["card"] for link in found["links"]] == ["fire A", "x B"]


def test_identity_text_of_marked_containers():
    html = (
        "<body><p>Ut</p><div id='Kontakt'>A <span class='contact'>B</span></div><address>C</address><div itemprop='taxID'>D</div>"
        "<div class='my company-info x'>E<script>no</script></div><div class='kontrakt'>Nei</div><nav>Meny</nav><footer>F</footer></body>"
    )
    found = _parse(html)
    assert found["identity_text"] == "A B C D E F" and found["main_text"] == "Ut A B C D E Nei"


def test_dates_of_the_markup():
    html = """<meta property="article:published_time" content=" 2024-01-02 "><meta name="date" content=""><time datetime="2024-01-05">5. jan</time>
      <div class="post-date">ute <span id="dato">1.1.2024</span></div><p class="candidate updated">nei</p>
      <script type="application/ld+json">{"@graph":[{"@type":["Thing","BlogPosting"],"datePublished":"2024-03-03"},{"@type":"Event","datePublished":"x"}]}</script>"""
    assert {(d["method"], d["raw"]) for d in _parse(html)["dates"]} == {
        ("meta_article_published_time", "2024-01-02"), ("time_datetime", "2024-01-05"), ("time_text", "5. jan"), ("date_labelled_element", "1.1.2024"),
        ("jsonld_article_date_published", "2024-03-03"),
    }


def test_role_cards(spark):
    whole = "<article><a href='/karriere/ledige-stillinger/2026/09/bedriftslege/'>{} Oslo Nordlys Konsern 18.10.2026</a></article>"
    assert cards(spark, whole.format("Bedriftslege")) == [
        ("Bedriftslege", "/karriere/ledige-stillinger/2026/09/bedriftslege/", "18.10.2026", "/karriere/ledige-stillinger/2026/09/bedriftslege/", "Bedriftslege Oslo Nordlys Konsern 18.10.2026")
    ]
    assert [c[0] for c in cards(spark, whole.format("Seniorlege"))] == ["Seniorlege Oslo Nordlys Konsern 18.10.2026"]
    nested = "<div><div><div><h2><a href='/jobb/kokk'>Kokk søkes</a></h2></div><p>Bergen<div>Frist 1.2.2024 <a href='/sok'>Send søknad</a></div></div></div>"
    assert cards(spark, nested) == [("Kokk søkes", "/jobb/kokk", "1.2.2024", "/sok", "Kokk søkes Bergen Frist 1.2.2024 Send søknad")]
    two = "<div>1.2.2024 <a href='/jobb/kokk'>Kokk søkes</a> <a href='/jobb/kelner'>Kelner søkes</a></div>"
    assert cards(spark, two) == []  # the date is of neither
    assert cards(spark, "<ul><li>1.2.2024<li><a href='/jobb/kokk'>Kokk søkes</a></ul>") == []  # nor of another item
    assert cards(spark, "<p>1.2.2024 <a href='/om/kokk'>Kokk søkes</a></p>") == []  # outside a careers section
    found = snapshot(spark, nested)
    again = found.unionByName(found)
    assert site_surface.job_cards(pages.page_links(again), again).count() == 1


def test_slug_titles(spark):
    def title(anchor, url):
        return spark.range(1).select(site_surface.title_before_details(F.lit(anchor), F.lit(url)).alias("t")).first()["t"]

    assert title("Daglig leder Ærø 1.1.2024", "https://a.no/jobb/daglig-leder-aero") == "Daglig leder Ærø"
    assert title("Daglig leder Oslo", "https://a.no/jobb/4711") == "Daglig leder Oslo"
    assert title("Leder", "https://a.no/jobb/leder-i-oslo") == "Leder"


def test_seeds(spark):
    entities = spark.createDataFrame([("1", "www.a.no"), ("2", None), ("3", "c.no")], "org string, website string")
    rows = [
        ("1", "https://ny.no", "https://p", "x", 1), ("1", " http://nyere.no ", "http://p", None, 2), ("1", "relativ.no", "https://p", "", 3), ("2", "https://b.no", "p.html", "", 1),
        ("9", "https://x.no", "https://p", "", 1), ("1", " http://nyere.no ", "http://p", None, 2), (None, "https://x.no", "https://p", "", 1), ("3", None, None, None, None),
    ]
    seed = spark.createDataFrame(rows, "org string, website string, proof_url string, proof string, position int")
    got, broken = seeds.apply_seeds(entities, seed)
    assert sorted((r.org, r.website, r.website_seed_source is not None) for r in got.collect()) == [("1", "http://nyere.no", True), ("2", None, False), ("3", "c.no", False)]
    assert sorted((r.org or "", r.rule) for r in broken.collect()) == [
        ("", "unknown_company"), ("1", "relative_website"), ("1", "repeated_seed"), ("2", "relative_proof"), ("3", "relative_website"), ("9", "unknown_company"),
    ]
