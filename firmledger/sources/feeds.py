"""RSS and Atom snapshots to dated same-site entries."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squash, squash_lower, word_count
from ..functions.web import resolve_link, same_site

# Titles that say nothing, and elements that carry a date.
GENERIC_FEED_TITLES = (
    "news", "nyheter", "aktuelt", "blog", "press", "presse", "home", "forside", "hello world", "hei verden", "sample page",
    "sample post",
)
DATE_ELEMENTS = ("pubdate", "published", "updated", "date")

_ENTRY = T.StructType(
    [T.StructField("position", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in ("title", "link", "published_date", "method", "raw_date")]
)


def _local(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1].casefold()


def _text(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _feed_date(raw: str) -> str | None:
    """Day of a mail-style or ISO date text."""
    for parse in (parsedate_to_datetime, lambda value: datetime.fromisoformat(value.replace("Z", "+00:00"))):
        try:
            moment = parse(raw)
        except (TypeError, ValueError, OverflowError):
            continue
        return (moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).date().isoformat()
    return None


def _entries(body: str | None) -> tuple[str, list[dict]]:
    """Feed kind and its entries in document order; the kind says why there are none."""
    try:
        root = ET.fromstring((body or "").encode("utf-8"))
    except ET.ParseError:
        return "invalid_xml", []
    wanted = {"rss": "item", "feed": "entry"}.get(_local(root.tag))
    if wanted is None:
        return "unsupported_root", []
    entries = []
    for position, node in enumerate(element for element in root.iter() if _local(element.tag) == wanted):
        entry = {"position": position, "title": "", "link": "", "published_date": None, "method": None, "raw_date": None}
        for child in node:
            name = _local(child.tag)
            if name == "title" and not entry["title"]:
                entry["title"] = _text(child)
            elif name == "link" and not entry["link"]:
                href = (child.get("href") or "").strip()
                usable = href and (child.get("rel") or "alternate").casefold() in ("", "alternate")
                entry["link"] = href if usable else _text(child)
            elif name in DATE_ELEMENTS and entry["published_date"] is None:
                raw = _text(child)
                entry.update(published_date=_feed_date(raw), method=f"feed_{name}", raw_date=raw)
        entries.append(entry)
    return ("rss" if wanted == "item" else "atom"), entries


def feed_entries(snapshots: DataFrame) -> DataFrame:
    """All entries of feed snapshots (org, feed_url, verified_url, content_sha256, retrieved_at, body)."""
    kept = [field for field in snapshots.schema.fields if field.name != "body"]
    schema = T.StructType(
        kept + [T.StructField("feed_type", T.StringType()), T.StructField("entries", T.ArrayType(_ENTRY))]
    )
    names = [field.name for field in kept]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [_entries(body) for body in batch["body"]]
            yield batch[names].assign(feed_type=[kind for kind, _ in parsed], entries=[rows for _, rows in parsed])

    feeds = snapshots.mapInPandas(parse, schema)
    return feeds.select(*names, "feed_type", F.explode_outer("entries").alias("entry"))


def current_entries(entries: DataFrame, as_of: str, per_feed: int | None = None) -> DataFrame:
    """Usable entries per feed in document order: same site, specific title, not future, at most five years old.

    ``pick`` is the rank in the feed; ``per_feed`` keeps the first ones only.
    """
    link = F.when(F.col("entry.link") != "", resolve_link(F.col("feed_url"), F.col("entry.link")))
    title = squash(F.col("entry.title"))
    bare = F.regexp_replace(squash_lower(F.col("entry.title")), r"^[ .!?:;\-]+|[ .!?:;\-]+$", "")
    day = F.to_date("entry.published_date")
    today = F.lit(as_of).cast("date")
    usable = (
        link.isNotNull()
        & same_site(F.col("feed_url"), F.col("verified_url"))
        & same_site(link, F.col("verified_url"))
        & (bare != "") & ~bare.isin(*GENERIC_FEED_TITLES) & (word_count(title) >= 2)
        & day.between(F.add_months(today, -60), today)
    )
    rows = entries.filter(F.coalesce(usable, F.lit(False))).select(
        "org", "feed_url", "verified_url", "content_sha256", "retrieved_at", "feed_type",
        F.col("entry.position").alias("position"), title.alias("title"), link.alias("url"),
        day.cast("string").alias("published_date"), F.col("entry.method").alias("date_method"),
        F.col("entry.raw_date").alias("raw_date"),
    )
    # The first usable entry of an address stands.
    rest = [name for name in rows.columns if name not in ("org", "feed_url", "url")]
    once = rows.groupBy("org", "feed_url", "url").agg(F.min_by(F.struct(*rest), F.col("position")).alias("_row"))
    flat = once.select("org", "feed_url", "url", "_row.*")
    order = Window.partitionBy("org", "feed_url").orderBy("position")
    picked = flat.withColumn("pick", F.row_number().over(order))
    if per_feed is not None:
        picked = picked.filter(F.col("pick") <= per_feed)
    return picked.withColumn(
        "evidence_span",
        F.concat(
            F.col("title"), F.lit("; published date "), F.col("published_date"), F.lit("; feed date evidence "),
            F.col("date_method"), F.lit(": "), F.col("raw_date"),
        ),
    )


def feed_screen(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """First feed candidate with usable entries per company, and how many entries it gave."""
    counted = entries.groupBy("org", "feed_url").agg(F.count(F.lit(1)).alias("updates"))
    tried = candidates.select("org", "position", F.col("url").alias("feed_url")).join(counted, ["org", "feed_url"])
    return tried.groupBy("org").agg(
        F.min_by("feed_url", "position").alias("feed_url"), F.min_by("updates", "position").alias("updates")
    )


def feed_screen_summary(verified: DataFrame, screened: DataFrame) -> DataFrame:
    return verified.select("org").distinct().join(screened, "org", "left").agg(
        F.count(F.lit(1)).alias("sites"), F.count("feed_url").alias("sites_with_activity"),
        F.coalesce(F.sum("updates"), F.lit(0)).alias("dated_updates"),
    )
