"""Headline, listing, profile and channel checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as m
from . import bindings as b
from . import records as rec
from .registry import check


@check(
    "J15_headline_mentions",
    sql="""WITH names AS (SELECT CAST(p_partkey AS VARCHAR) AS org, lower(p_name) AS run FROM part),
      titles AS (SELECT doc_id, ['', 'kort nytt fra ', 'store '][doc_id % 3 + 1] AS lead, doc_id % (SELECT count(*) FROM part) AS k FROM documents)
      SELECT DISTINCT n.org, doc_id FROM titles JOIN part p ON p.p_partkey = titles.k JOIN names n ON n.run = lower(p.p_name) WHERE doc_id % 3 <> 2""",
)
def headline_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every document gets a headline that names one part: at its start, after an allowed word, or inside another name."""
    part = b.table(spark, d, "part").select(F.col("p_partkey"), F.col("p_name"))
    total = part.agg(F.count(F.lit(1)).alias("n"))
    documents = b.table(spark, d, "documents").select("doc_id").join(F.broadcast(total), F.lit(True))
    titled = documents.withColumn("p_partkey", F.pmod("doc_id", F.col("n"))).join(part, "p_partkey")
    lead = F.element_at(F.array(F.lit(""), F.lit("Kort nytt fra "), F.lit("Store ")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    headlines = titled.select("doc_id", F.concat(lead, F.initcap("p_name"), F.lit(" - Avisen")).alias("title"))
    names = part.select(F.col("p_partkey").cast("string").alias("org"), F.col("p_name").alias("name"))
    return m.headline_mentions(names, headlines, "doc_id", "title")


def _place_entities(spark: SparkSession, d: str) -> DataFrame:
    number = (rec.key() + 100_000).cast("string")
    return b.entity(spark, d).select(
        "org", F.concat(F.lit("Kunde "), number, F.lit(" Handel AS")).alias("name"), "municipality",
        F.concat(F.lit("Gata "), number).alias("street_address"), F.lit("0150").alias("postcode"), F.lit("Oslo").alias("post_town"),
        F.concat(F.lit("22"), number).alias("phone"), F.concat(F.lit("https://kunde"), number, F.lit(".no/")).alias("verified_site"),
        F.array(F.concat(F.lit("Kari Nordmann "), number)).alias("leaders"),
    )


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Two listings per company: the right one with some channels, and a lookalike elsewhere; every tenth listing is doubled."""
    number = (rec.key() + 100_000).cast("string")
    third = F.pmod(rec.key(), F.lit(3))
    right = F.struct(
        F.lit("right").alias("kind"), F.concat(F.lit("Kunde "), number, F.lit(" Handel")).alias("title"),
        F.when(third == 0, F.concat(F.lit("Gata "), number, F.lit(", 0150 Oslo"))).otherwise(F.lit("Ukjent vei 3")).alias("address"),
        F.when(third == 1, F.concat(F.lit("+47 22"), number)).otherwise(F.lit("")).alias("phone"),
        F.lit("").alias("website"), F.lit(100).alias("review_count"),
    )
    other = F.struct(
        F.lit("other").alias("kind"), F.concat(F.lit("Butikk "), number).alias("title"), F.lit("Annen gate 1").alias("address"),
        F.lit("99999999").alias("phone"), F.lit("https://annet.no").alias("website"), F.lit(5).alias("review_count"),
    )
    twin = F.when(
        F.pmod(rec.key(), F.lit(10)) == 0,
        F.struct(F.lit("twin").alias("kind"), *[right[name].alias(name) for name in ("title", "address", "phone", "website", "review_count")]),
    )
    rows = b.entity(spark, d).select("org", F.explode(F.array_compact(F.array(right, other, twin))).alias("p"))
    return rows.select("org", F.concat("p.kind", F.lit("-"), "org").alias("place_id"), "p.title", "p.address", "p.phone", "p.website", "p.review_count")


@check(
    "J11_place_scores",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """listed AS (SELECT org, k, length(CAST(k + 100000 AS VARCHAR)) AS n, unnest(['right', 'other', 'twin']) AS kind FROM entity)
        SELECT org, concat(kind, '-', org) AS place_id, kind <> 'other' AND k % 3 IN (0, 1) AS accepted,
          CASE WHEN kind = 'other' THEN round_even(4 * (1.0 / 3) + log10(5) / 5, 4) ELSE round_even(4 + CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END + 0.4, 4) END AS score,
          -- of 'kunde N handel' and 'butikk N' the blocks ' N' and 'k' are common
          CASE WHEN kind = 'other' THEN round_even(2.0 * (n + 2) / (20 + 2 * n), 4) ELSE 1.0 END AS fuzzy_score
        FROM listed WHERE kind <> 'twin' OR k % 10 = 0""",
    ),
)
def place_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all listings: right ones, lookalikes and doubled ones."""
    return m.score_places(_place_entities(spark, d), _places(spark, d)).select("org", "place_id", "accepted", "score", "fuzzy_score")


@check(
    "W9_best_places",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE WHEN k % 3 = 2 THEN 'no_exact_match' WHEN k % 10 = 0 THEN 'ambiguous_exact_match' ELSE 'exact_match' END AS status,
          CASE WHEN k % 3 <> 2 AND k % 10 <> 0 THEN concat('right-', org) END AS place_id FROM entity""",
    ),
)
def best_places(spark: SparkSession, d: str) -> DataFrame:
    entities = _place_entities(spark, d)
    return m.best_places(m.score_places(entities, _places(spark, d)), entities).select("org", "status", "place_id")


@check(
    "W9_place_observations",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """c AS (SELECT count(*) AS n FROM entity WHERE k % 3 <> 2 AND k % 10 <> 0)
        SELECT signal_type, n AS observations FROM c, (VALUES ('place_summary'), ('review_summary'), ('profile_metrics'), ('buzz_metrics'), ('review')) t(signal_type)""",
    ),
)
def place_observations(spark: SparkSession, d: str) -> DataFrame:
    entities = _place_entities(spark, d)
    places = _places(spark, d).withColumn("rating", F.lit(4.5)).withColumn("link", F.concat(F.lit("https://maps.example/"), F.col("place_id")))
    chosen = m.best_places(m.score_places(entities, places), entities)
    reviews = places.select(
        "org", "place_id", F.concat(F.lit("r-"), F.col("place_id")).alias("review_id"), F.lit(5.0).alias("stars"), F.lit("Bra").alias("text"),
        F.lit("u1").alias("reviewer_id"),
    )
    rows = m.place_observations(chosen, places, reviews, b.RETRIEVED_AT)
    return rows.groupBy("signal_type").agg(F.count(F.lit(1)).alias("observations"))


@check(
    "J16_profile_rules",
    sql=b.with_ctes(
        b.ENTITY_SQL,
        """SELECT org, CASE k % 5 WHEN 0 THEN 'name_and_domain' WHEN 1 THEN 'full_name_and_location' WHEN 2 THEN 'full_name_and_job_link'
          WHEN 3 THEN 'alias_location_and_leader' END AS matched_rule FROM entity""",
    ),
)
def profile_rules(spark: SparkSession, d: str) -> DataFrame:
    entities = _place_entities(spark, d)
    kind = F.pmod(rec.key(), F.lit(5))
    number = (rec.key() + 100_000).cast("string")
    profiles = entities.select(
        "org", F.lit("https://network.example/p").alias("page_url"),
        F.when(kind == 0, F.concat(F.lit("Kunde "), number, F.lit(" Handel"))).when(kind == 3, F.lit("Merket Kjent")).when(
            kind == 4, F.lit("Noe annet")
        ).otherwise(F.col("name")).alias("profile_name"),
        F.when(kind == 0, F.concat(F.lit("https://www.kunde"), number, F.lit(".no"))).alias("profile_site"),
        F.when(kind.isin(1, 3), F.concat(F.col("municipality"), F.lit(", Norge"))).alias("profile_location"),
        F.when(kind == 3, F.concat(F.lit("Ledet av Kari Nordmann "), number)).alias("profile_text"),
        F.when(kind == 3, F.array(F.lit("Merket Kjent AS"))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        (kind == 2).alias("job_link"),
    )
    return m.match_rules(m.profile_features(entities, profiles), m.PROFILE_RULES).select("org", "matched_rule")


@check("J16_directory_pages", sql=b.with_ctes(b.ENTITY_SQL, "SELECT org, k % 2 = 0 AS exact_entity FROM entity"))
def directory_pages(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat_ws(" ", F.col("org").substr(1, 3), F.col("org").substr(4, 3), F.col("org").substr(7, 3))
    text = F.concat(F.lit("Bedrift: "), F.upper("name"), F.lit(" org "), F.when(F.pmod(rec.key(), F.lit(2)) == 0, written).otherwise(F.lit("ukjent")))
    pages = b.entity(spark, d).select("org", text.alias("text"))
    return m.exact_directory_pages(b.entity(spark, d), pages).select("org", "exact_entity")


@check(
    "W19_channels",
    sql=b.with_ctes(
        b.ENTITY_SQL, "SELECT org, CASE WHEN k % 3 < 2 THEN concat('https://video.example/', k) END AS channel_url, k % 3 < 2 AS accepted FROM entity"
    ),
)
def channels(spark: SparkSession, d: str) -> DataFrame:
    entities = _place_entities(spark, d)
    kind, number = F.pmod(rec.key(), F.lit(3)), (rec.key() + 100_000).cast("string")
    url = F.concat(F.lit("https://video.example/"), rec.key().cast("string"))
    # Two hits, one hit with the own domain in its text, or one bare hit; a stranger has many hits.
    mine = F.struct(url.alias("channel_url"), F.col("name").alias("channel_name"), F.lit("film").alias("description"))
    linked = F.struct(
        url.alias("channel_url"), F.col("name").alias("channel_name"), F.concat(F.lit("Se kunde"), number, F.lit(".no")).alias("description")
    )
    stranger = F.struct(F.lit("https://video.example/x").alias("channel_url"), F.lit("Andre").alias("channel_name"), F.lit("").alias("description"))
    rows = F.when(kind == 0, F.array(mine, mine, stranger, stranger, stranger)).when(kind == 1, F.array(linked, stranger)).otherwise(F.array(mine))
    hits = entities.select("org", F.inline(rows))
    return m.pick_channels(entities, hits).select("org", "channel_url", "accepted")
