"""HTML snapshots to page events.

The per-row step is the standard library's HTML parser inside ``mapInPandas``; everything around it is native. A page becomes one
array of text runs; elements and links are ranges over it, so what a page yields grows with the page alone. Texts are kept whole.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import SOCIAL_HOSTS, registered_domain, resolve_link, with_social_profile

_IDENTITY_PROPS = {"legalName", "address", "telephone", "email", "taxID", "vatID"}
# Words of an id or class that mark legal, contact or footer text.
IDENTITY_CONTAINERS = (
    "footer", "kontakt", "contact", "personvern", "privacy", "legal", "impressum", "company-info", "companyinfo", "selskapsinfo",
    "organisasjonsnummer", "orgnr",
)
# An id or class that marks a date, and a date as it stands on a card.
DATE_CONTAINER = re.compile(r"(?:^|[-_ ])(?:date|published|publisert|dato)(?:$|[-_ ])", re.IGNORECASE)
CARD_DATE = r"\b((?:20\d{2}-[01]?\d-[0-3]?\d|[0-3]?\d[./-][01]?\d[./-](?:20)?\d{2}))\b"
# Markup that states a day of publication, as (attribute, value) of a meta element, and its method.
META_DATES = {
    ("property", "article:published_time"): "meta_article_published_time",
    ("itemprop", "datePublished"): "meta_itemprop_date_published",
    ("name", "date"): "meta_name_date",
    ("name", "pubdate"): "meta_name_pubdate",
}
_DATED_TYPES = {"NewsArticle": "jsonld_newsarticle_date_published", "Article": "jsonld_article_date_published", "BlogPosting": "jsonld_article_date_published"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template"}
_CHROME = {"nav", "header", "footer", "aside"}
_KINDS = {tag: ("hidden",) for tag in _HIDDEN} | {tag: ("chrome",) for tag in _CHROME}
_KINDS |= {"title": ("title",), "address": ("identity",), "footer": ("chrome", "identity"), "time": ("time_text",)}
# A card does not reach beyond one of these.
_SCOPES = {"html", "body", "main", "nav", "header", "footer", "aside", "ul", "ol", "dl", "table", "tbody", "form"}
# An opening tag ends an open one of these kinds, unless a scope has been opened in between.
_ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
# Characters of HTML that a task holds parsed at a time.
SLICE = 1_000_000
_ORGANISATION_TYPES = {"Organization", "Corporation", "LocalBusiness", "Store", "Restaurant"}
_DATED_RUN = re.compile(CARD_DATE)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_INT, _TEXT = T.IntegerType(), T.StringType()
_LINK = _struct(position=_INT, href=_TEXT, text=_TEXT, card=_TEXT, scope=_INT)
_ELEMENT = _struct(start=_INT, end=_INT, first_link=_INT, end_link=_INT, scope=_INT, dated=_INT)
_PARSED = _struct(
    title=_TEXT, description=_TEXT, main_text=_TEXT, identity_text=_TEXT, runs=T.ArrayType(_TEXT), links=T.ArrayType(_LINK),
    elements=T.ArrayType(_ELEMENT), dates=T.ArrayType(_struct(method=_TEXT, raw=_TEXT)), jsonld=T.ArrayType(_TEXT), job_postings=T.ArrayType(_TEXT),
)


class _Element:
    """An open or closed element: a range of text runs and a range of links."""

    __slots__ = ("tag", "start", "end", "first_link", "end_link", "scope", "kinds", "dated_inside")

    def __init__(self, tag: str, start: int, first_link: int, scope: int, kinds: tuple[str, ...]) -> None:
        self.tag, self.start, self.first_link, self.scope, self.kinds = tag, start, first_link, scope, kinds
        self.end, self.end_link, self.dated_inside = start, first_link, False


class _PageParser(HTMLParser):
    """Reads a page into one array of text runs and ranges over it.

    An element is a range of runs and of links; whether a run is hidden, part of the page's chrome or of its identity text is
    told by counters of open elements, so no tag looks at the whole stack. What a page yields grows with the page: nested
    elements share its runs, and no text is copied for each of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description = [], ""
        self.runs: list[str] = []
        self.main: list[str] = []
        self.identity: list[str] = []
        self.dated: list[int] = []
        self.jsonld: list[str] = []
        self.links: list[tuple[str, int, int]] = []  # href, scope, group of links to one address in a row
        self.anchors: list[tuple[int, int, int]] = []  # link, start, end
        self.dates: dict[tuple[str, str], None] = {}
        self.labelled: list[tuple[str, int, int]] = []
        self.elements: list[_Element] = []
        self._stack: list[_Element] = []
        self._open: defaultdict = defaultdict(int)  # by tag name, by kind, and by tag name within a scope
        self._scopes = [0]
        self._script: list[str] | None = None
        self._anchor: tuple[int, int] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {name: value or "" for name, value in attrs}
        if tag == "meta":
            self._meta(values)
        if tag == "script" and values.get("type", "").strip() == "application/ld+json":
            self._script = []
        ends = _ENDS.get(tag, ())
        while ends and self._stack and self._stack[-1].tag not in _SCOPES and any(self._open["", name, self._scopes[-1]] for name in ends):
            self._close()
        if tag == "a":
            self._end_anchor()
        if tag in _VOID:
            return
        kinds = _KINDS.get(tag, ())
        if values:
            mark = f"{values.get('id', '')} {values.get('class', '')}".strip().casefold()
            if values.get("itemprop") in _IDENTITY_PROPS or (mark and any(term in mark for term in IDENTITY_CONTAINERS)):
                kinds += ("identity",)
            if mark and DATE_CONTAINER.search(mark):
                kinds += ("date_labelled_element",)
        if tag == "time":
            self._date("time_datetime", values.get("datetime", ""))
        element = _Element(tag, len(self.runs), len(self.links), self._scopes[-1], kinds)
        self._stack.append(element)
        for key in (*kinds, tag):
            self._open[key] += 1
        if tag in _ENDS:
            self._open["", tag, self._scopes[-1]] += 1
        if tag in _SCOPES:
            self._scopes.append(len(self.elements) + len(self._stack))
        if "data-href" in values or (tag == "iframe" and "src" in values):
            self._link(values.get("data-href") or values.get("src", ""))
        if tag == "a" and "href" in values:
            self._anchor = (len(self.links), len(self.runs))
            self._link(values["href"])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _meta(self, values: dict[str, str]) -> None:
        content = values.get("content", "")
        if (values.get("name") == "description" or values.get("property") == "og:description") and not self.description:
            self.description = content.strip()
        for (attribute, wanted), method in META_DATES.items():
            if values.get(attribute) == wanted:
                self._date(method, content)

    def _date(self, method: str, raw: str) -> None:
        raw = " ".join(raw.split())
        if raw:
            self.dates[method, raw] = None

    def _link(self, href: str) -> None:
        last = self.links[-1] if self.links else ("", 0, -1)
        self.links.append((href, self._scopes[-1], last[2] + (href != last[0] or last[2] < 0)))

    def _end_anchor(self) -> None:
        if self._anchor is not None:
            self.anchors.append((*self._anchor, len(self.runs)))
            self._anchor = None

    def _close(self) -> None:
        """End the innermost open element."""
        element = self._stack.pop()
        if element.tag == "a":
            self._end_anchor()
        element.end, element.end_link = len(self.runs), len(self.links)
        if element.tag in _SCOPES:
            self._scopes.pop()
        for key in (*element.kinds, element.tag):
            self._open[key] -= 1
        if element.tag in _ENDS:
            self._open["", element.tag, element.scope] -= 1
        # The innermost labelled elements state dates, so nested ones do not repeat each other's text.
        if element.kinds or element.dated_inside:
            own = [kind for kind in element.kinds if kind in ("time_text", "date_labelled_element")]
            if own and not element.dated_inside:
                self.labelled += [(kind, element.start, element.end) for kind in own]
            if self._stack and (own or element.dated_inside):
                self._stack[-1].dated_inside = True
        if element.end_link > element.first_link and element.tag not in _SCOPES:
            self.elements.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self._script is not None:
            self.jsonld.append("".join(self._script))
            self._script = None
        if tag == "a":
            self._end_anchor()
        while self._open[tag] > 0:
            name = self._stack[-1].tag
            self._close()
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self._script is not None:
            self._script.append(data)
            return
        text = " ".join(data.split())
        if not text or self._open["hidden"]:
            return
        if self._open["title"]:
            self.title.append(text)
            return
        if _DATED_RUN.search(text):
            self.dated.append(len(self.runs))
        self.runs.append(text)
        if self._open["identity"]:
            self.identity.append(text)
        if not self._open["chrome"]:
            self.main.append(text)

    def row(self) -> dict:
        self._end_anchor()
        while self._stack:
            self._close()
        texts = {link: " ".join(self.runs[start:end]) for link, start, end in self.anchors}
        cards = self._cards()
        links = [
            {"position": k, "href": href, "text": texts.get(k, ""), "card": cards.get(k, ""), "scope": scope} for k, (href, scope, _) in enumerate(self.links)
        ]
        elements = []
        for e in self.elements:
            at = bisect_left(self.dated, e.start)
            dated = self.dated[at] if at < len(self.dated) and self.dated[at] < e.end else -1
            elements.append({"start": e.start, "end": e.end, "first_link": e.first_link, "end_link": e.end_link, "scope": e.scope, "dated": dated})
        organisations, postings = self._structured()
        for kind, start, end in self.labelled:
            self._date(kind, " ".join(self.runs[start:end]))
        return {
            "title": " ".join(self.title), "description": self.description, "main_text": " ".join(self.main), "identity_text": " ".join(self.identity),
            "runs": self.runs, "links": links, "elements": elements, "dates": [{"method": m, "raw": raw} for m, raw in self.dates],
            "jsonld": organisations, "job_postings": postings,
        }

    def _cards(self) -> dict[int, str]:
        """Text of the largest element around the first link of an address in a row that holds no other address."""
        largest: dict[int, _Element] = {}
        for e in self.elements:  # inner ones before outer ones
            first, last = self.links[e.first_link], self.links[e.end_link - 1]
            if first[2] == last[2] and first[1] == e.scope:
                largest[first[2]] = e
        first_of: dict[int, int] = {}
        for k, (_, _, group) in enumerate(self.links):
            first_of.setdefault(group, k)
        return {first_of[group]: " ".join(self.runs[e.start : e.end]) for group, e in largest.items()}

    def _structured(self) -> tuple[list[str], list[str]]:
        organisations: list[str] = []
        postings: list[str] = []
        for block in self.jsonld:
            try:
                node = json.loads(block)
            except (ValueError, RecursionError):  # a block that is no JSON, or nested beyond the reader
                continue
            for kinds, found in _typed(node):
                if kinds & _ORGANISATION_TYPES:
                    organisations.append(json.dumps(found, ensure_ascii=False, sort_keys=True))
                if "JobPosting" in kinds:
                    postings.append(json.dumps(found, ensure_ascii=False, sort_keys=True))
                for kind, method in _DATED_TYPES.items():
                    if kind in kinds and isinstance(found.get("datePublished"), str):
                        self._date(method, found["datePublished"])
        return organisations, postings


def _typed(node: object) -> Iterator[tuple[set[str], dict]]:
    """Nodes of a JSON value with their types, at any depth, in document order."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            kind = node.get("@type")
            yield {str(item) for item in (kind if isinstance(kind, list) else [kind])}, node
            waiting += reversed(node.values())
        elif isinstance(node, list):
            waiting += reversed(node)


def _parse(html: str | None) -> dict | None:
    """Content of one page; None where it cannot be read, so that one page never ends the job."""
    parser = _PageParser()
    try:
        parser.feed(html or "")
        parser.close()
        return parser.row()
    except (ValueError, AssertionError, RecursionError):
        return None


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch: one page and fewer than ``SLICE`` characters of others.

    A parsed page takes many times the memory of its text; only the pages of one part are held parsed at a time.
    """
    ends = batch["html"].fillna("").str.len().cumsum()
    for _, part in batch.groupby(ends // SLICE, sort=False):
        yield part


def page_events(snapshots: DataFrame) -> DataFrame:
    """Page events of fetched snapshots.

    Input: org, requested_url, final_url, status_code, content_type, page_kind, retrieved_at, html. A failed status
    or another content type becomes an event without content. Links and JSON-LD organisations stay arrays of the page.
    """
    http_ok = F.col("status_code").between(200, 299)
    is_html = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html"))
    base = snapshots.select(
        "org", "requested_url", "final_url", "status_code", "content_type", "page_kind", "retrieved_at", "html",
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_sha256"),
        F.length(F.coalesce("html", F.lit(""))).cast("bigint").alias("n_chars"),
        F.when(F.col("status_code").isin(404, 410), F.lit("not_found"))
        .when(~http_ok | ~is_html, F.lit("source_error"))
        .otherwise(F.lit("available"))
        .alias("status"),
        F.when(~http_ok, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        .when(~is_html, F.concat(F.lit("Unsupported content type: "), F.coalesce("content_type", F.lit(""))))
        .alias("error"),
    )
    kept = [field for field in base.schema.fields if field.name != "html"]
    schema = T.StructType(kept + _PARSED.fields)
    names = [field.name for field in kept]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = {field.name: [] if isinstance(field.dataType, T.ArrayType) else None for field in _PARSED.fields}
        for batch in (part for whole in batches for part in _slices(whole)):
            rows = [
                _parse(html) if status == "available" else empty for html, status in zip(batch["html"], batch["status"], strict=True)
            ]
            broken = [row is None for row in rows]
            batch = batch.assign(
                status=batch["status"].mask(broken, "source_error"), error=batch["error"].mask(broken, "Page could not be parsed")
            )
            rows = [empty if row is None else row for row in rows]
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(rows, columns=list(empty))], axis=1)

    events = base.mapInPandas(parse, schema)
    return events.withColumn("registered_domain", registered_domain(F.col("final_url")))


def page_links(events: DataFrame) -> DataFrame:
    """One row per link with its absolute address without query and fragment."""
    rows = events.filter(F.col("status") == "available").select(
        "org", "final_url", "content_sha256", "retrieved_at", "page_kind", F.explode("links").alias("link")
    )
    rows = rows.withColumn("_absolute", resolve_link(F.col("final_url"), F.col("link.href")))
    absolute = F.col("_absolute")
    return rows.select(
        "org", "final_url", "content_sha256", "retrieved_at", "page_kind",
        F.col("link.position").alias("position"),
        F.col("link.href").alias("href"),
        F.col("link.text").alias("anchor_text"),
        F.col("link.card").alias("card_text"),
        F.col("link.scope").alias("scope"),
        absolute.alias("url"),
        F.regexp_replace(absolute, r"[?#].*$", "").alias("clean_url"),
    )


def date_candidates(events: DataFrame) -> DataFrame:
    """Days of publication that a page's own markup states: (org, url, method, raw), repeats once."""
    rows = events.filter(F.col("status") == "available").select("org", F.col("final_url").alias("url"), F.inline("dates"))
    return rows.select("org", "url", "method", "raw").distinct()


def _embedded_target(url: Column) -> Column:
    """Target of a page-plugin address, else the address itself."""
    plugin = url.rlike(r"^https?://(?:www\.)?facebook\.com/plugins/")
    target = F.try_url_decode(F.regexp_extract(url, r"[?&]href=([^&#]+)", 1))
    return F.when(plugin & (target != ""), target).otherwise(url)


def social_links(events: DataFrame) -> DataFrame:
    """Distinct company profiles a page links to or names as ``sameAs``: (org, final_url, platform, url, origin)."""
    page = ("org", "final_url", "content_sha256", "retrieved_at", "page_kind")
    linked = page_links(events).select(*page, F.lit("link").alias("origin"), _embedded_target(F.col("url")).alias("target"))
    same_as = events.filter((F.col("status") == "available") & (F.size("jsonld") > 0)).select(
        *page, F.lit("same_as").alias("origin"), F.explode("jsonld").alias("node")
    )
    # sameAs is one address or a list of them.
    raw = F.get_json_object("node", "$.sameAs")
    urls = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    named = same_as.select(*page, "origin", F.explode(urls).alias("target")).withColumn("target", F.trim("target"))
    # Only addresses that mention a social host at all go through the profile rules.
    hosts = "|".join(host.replace(".", r"\.") for host in SOCIAL_HOSTS)
    found = with_social_profile(linked.unionByName(named).filter(F.col("target").rlike(hosts)), F.col("target"))
    return found.filter(F.col("profile").isNotNull()).select(*page, "origin", "profile.platform", "profile.url").distinct()


def structured_names(jsonld: Column) -> Column:
    """Names of JSON-LD organisations."""
    return F.array_compact(
        F.flatten(
            F.transform(
                jsonld,
                lambda node: F.array(*[F.get_json_object(node, f"$.{name}") for name in ("name", "legalName", "alternateName")]),
            )
        )
    )
