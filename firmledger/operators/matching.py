"""Third-party candidates to companies: headlines, listings, profiles and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical_hash, material_id
from ..functions.orgnum import digits
from ..functions.staging import bound, with_stage
from ..functions.text import fold, norwegian_phone, squash_lower, tokens
from ..functions.values import review_label
from ..functions.web import bare_host
from ..model import OBSERVATION, conform

# Words that may stand before a company name in a headline.
HEADLINE_PREDECESSORS = ("av", "for", "fra", "hos", "i", "med", "om", "på", "til", "og", "kjøper", "velger")
PLACE_NAME_STOP = ("as", "asa", "sa", "enk", "nuf", "da", "ans", "ba", "stiftelsen", "sameiet", "avd", "avdeling")
GENERIC_PLACE_TOKENS = ("holding", "eiendom", "invest", "bolig", "service", "drift", "gruppen", "group")
CHANNEL_STOP = ("as", "asa", "sa", "da", "ans", "enk", "nuf")


# --- J15: headlines ------------------------------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9æøå]+)"), F.lit(1))


def name_mentions(entities: DataFrame, headlines: DataFrame, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(name, key) pairs where a headline holds a company's name in full, at its start or after an allowed word; and (org, name).

    Every headline yields its word runs of the lengths that names have, and the runs meet the distinct names exactly. A word
    that opens very many names and headlines therefore never makes candidate pairs, and neither does a name that many companies
    share: its mentions and its companies are rows of two tables.
    """
    names = entities.select("org", _words(F.col("name")).alias("_name")).filter(F.size("_name") > 0)
    names = names.select("org", F.array_join("_name", " ").alias("_run"), F.size("_name").alias("_n"))
    # One row: the distinct word counts of names, a few dozen numbers at most.
    lengths = names.agg(F.collect_set("_n").alias("_lengths"))
    stripped = F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"(?s)^(.*) - .*$", "$1")
    rows = headlines.select(F.col(key), _words(stripped).alias("_title")).filter(F.size("_title") > 0)
    # The length row joins on a constant; nothing multiplies.
    runs = rows.join(F.broadcast(lengths), F.lit(True)).select(key, "_title", F.explode("_lengths").alias("_n"))
    runs = runs.filter(F.col("_n") <= F.size("_title")).select(
        key, "_title", "_n", F.explode(F.sequence(F.lit(1), F.size("_title") - F.col("_n") + 1)).alias("_at")
    )
    before = F.try_element_at("_title", F.col("_at") - 1)
    allowed = (F.col("_at") == 1) | F.when(F.col("_at") > 1, before.isin(*HEADLINE_PREDECESSORS))
    grams = runs.filter(allowed).select(key, F.array_join(F.slice("_title", F.col("_at"), F.col("_n")), " ").alias("_run")).distinct()
    members = names.select("org", F.col("_run").alias("name")).distinct()
    found = grams.join(members.select(F.col("name").alias("_run")).distinct(), "_run")
    return found.select(F.col("_run").alias("name"), key), members


def headline_mentions(entities: DataFrame, headlines: DataFrame, key: str, title: str) -> DataFrame:
    """The pairs of :func:`name_mentions` as (org, key): as many rows as a name's mentions times its companies.

    Only a company of several names can meet a headline twice, so the pairs of all others are not dealt out again to be made distinct.
    """
    found, members = name_mentions(entities, headlines, key, title)
    counted = members.groupBy("org").agg(F.count(F.lit(1)).alias("_names"), F.min("name").alias("name"))
    single = found.join(counted.filter(F.col("_names") == 1), "name").select("org", key)
    several = members.join(counted.filter(F.col("_names") > 1).select("org"), "org", "left_semi")
    return single.unionByName(found.join(several, "name").select("org", key).distinct())


def _first_news(rows: DataFrame, by: str, most: int) -> DataFrame:
    """News once per (title, publisher), the first ones of each ``by`` in feed order."""
    again = rows.groupBy(by, F.lower("title").alias("_t"), F.lower("publisher").alias("_p")).agg(
        F.min_by(F.struct("title", "publisher", "link", "retrieved_at", "position"), F.struct("position", "link")).alias("h")
    )
    order = Window.partitionBy(by).orderBy("h.position", "h.link")
    return again.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select(by, "h.*")


def news_observations(mentions: DataFrame, members: DataFrame, headlines: DataFrame, key: str, per_company: int) -> DataFrame:
    """Mentions once per (title, publisher), the first ones per company in feed order.

    ``mentions`` and ``members`` are those of :func:`name_mentions`; ``headlines`` holds the key, title, publisher, link, retrieved_at and
    position. The first news are chosen per name, then among the names of a company: what is not among the first of a name
    is not among the first of its companies, so that companies of one name share that work.
    """
    named = _first_news(mentions.join(headlines, key), "name", per_company)
    picked = _first_news(members.join(named, "name"), "org", per_company)
    observations = picked.select(
        material_id("news-title-", 24, F.col("org"), F.col("title"), F.col("publisher")).alias("id"), "org",
        F.lit("news").alias("platform"), F.lit("public_mention").alias("signal_type"), F.col("link").alias("source_url"),
        "retrieved_at", F.sha2(F.concat_ws("|", "title", "publisher"), 256).alias("content_sha256"),
        F.lit(True).alias("exact_entity"),
        F.array(F.create_map(F.lit("type"), F.lit("exact_legal_name_in_news_title"))).alias("identity_proof"),
        F.lit("rights_review_experiment").alias("acquisition_mode"), F.lit("review_required").alias("rights_status"),
        F.lit("public_news").alias("source_class"), F.col("title").alias("evidence_span"),
        F.lit("independent_news_discovery").alias("strategy"),
    )
    return conform(observations, OBSERVATION)


# --- J11, W9: place listings -------------------------------------------------------------------------------

def _longest_block(left: Column, right: Column) -> Column:
    """Longest common block of two texts, the first in ``left`` where several are as long: struct with size and place."""

    def step(s: Column, _: Column) -> Column:
        grows = F.contains(right, F.substr(left, s.at, s.size + 1))
        return F.when(grows, F.struct(s.at.alias("at"), (s.size + 1).alias("size"), s.at.alias("place"))).otherwise(
            F.struct((s.at + 1).alias("at"), s.size.alias("size"), s.place.alias("place"))
        )

    # Each step moves the end of the probe by one character, so as many steps as characters see every block that is longer.
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("size"), F.lit(1).alias("place"))
    return F.aggregate(F.sequence(F.lit(1), F.length(left)), start, step)


def similarity(left: Column, right: Column) -> Column:
    """Matching-block ratio of two names: twice the characters in common blocks over all characters; 0 for null or empty names.

    The longest common block is taken, then those of what lies left of it in both names and of what lies right of it, and so on;
    the first of equally long blocks counts. No character is passed over as too frequent, however long the names are.
    """
    pair = F.struct(left.alias("a"), right.alias("b"))

    def part(open_: Column, p: Column, block: Column, matched: Column) -> Column:
        place = F.position(F.substr(p.a, block.place, block.size), p.b)
        return bound(
            place,
            lambda at: F.struct(
                F.concat(
                    open_,
                    F.filter(
                        F.array(
                            F.struct(F.substr(p.a, F.lit(1), block.place - 1).alias("a"), F.substr(p.b, F.lit(1), at - 1).alias("b")),
                            F.struct(F.substr(p.a, block.place + block.size).alias("a"), F.substr(p.b, at + block.size).alias("b")),
                        ),
                        lambda side: (side.a != "") & (side.b != ""),
                    ),
                ).alias("open"),
                (matched + block.size).alias("matched"),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        last = F.element_at(state.open, -1)
        rest = F.slice(state.open, 1, F.size(state.open) - 1)
        found = bound(
            last,
            lambda p: bound(
                _longest_block(p.a, p.b),
                lambda block: F.when(block.size == 0, F.struct(rest.alias("open"), state.matched.alias("matched"))).otherwise(
                    part(rest, p, block, state.matched)
                ),
            ),
        )
        return F.when(F.size(state.open) == 0, state).otherwise(found)

    # A block leaves at most two pairs and takes at least one character of both names, which bounds the number of steps.
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(left), F.length(right)) + 1)
    start = F.struct(F.array(pair).alias("open"), F.lit(0).alias("matched"))
    matched = F.aggregate(steps, start, step, lambda state: state.matched)
    ratio = 2.0 * matched / (F.length(left) + F.length(right))
    return F.when((left != "") & (right != ""), ratio).otherwise(F.lit(0.0))


def place_name_tokens(value: Column) -> Column:
    return F.filter(
        tokens(value), lambda word: ~word.isin(*PLACE_NAME_STOP) & ((F.length(word) >= 3) | word.rlike("^[0-9]+$"))
    )


def score_places(entities: DataFrame, places: DataFrame) -> DataFrame:
    """Match score and acceptance of place listings of a company.

    ``entities``: org, name, street_address, postcode, post_town, phone, verified_site. ``places``: org, place_id, title,
    address, phone, website, review_count. Acceptance needs the name with one strong channel, two thirds of it with two,
    or a near-equal name on the company's own verified domain.
    """
    own = entities.select(
        "org", "name", "street_address", "postcode", "post_town", F.col("phone").alias("_own_phone"), "verified_site"
    )
    rows = places.join(own, "org")
    rows = rows.withColumn("_target", place_name_tokens(F.col("name"))).withColumn("_title", place_name_tokens(F.col("title")))
    rows = rows.withColumn("_words", tokens(F.col("address")))
    target = F.array_distinct("_target")
    overlap = F.size(F.array_intersect("_target", "_title"))
    name_score = F.when(F.size(target) > 0, overlap / F.nullif(F.size(target), F.lit(0))).otherwise(F.lit(0.0))

    def inside(needed: Column) -> Column:
        return F.size(F.array_except(needed, F.col("_words"))) == 0

    street, town = tokens(F.col("street_address")), tokens(F.col("post_town"))
    code = F.coalesce("postcode", F.lit(""))
    coded = F.array_contains("_words", code)
    address_match = (F.size(street) > 0) & inside(street) & ((code == "") | coded)
    town_match = (code != "") & coded & ((F.size(town) == 0) | inside(town))
    phone = norwegian_phone(F.col("_own_phone"))
    phone_match = (F.length(phone) >= 5) & (phone == norwegian_phone(F.col("phone")))

    def host(value: str) -> Column:
        raw = F.trim(F.coalesce(value, F.lit("")))
        return bare_host(F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw)))

    expected, offered = host("verified_site"), host("website")
    site_match = (expected != "") & (offered != "") & ((offered == expected) | F.endswith(offered, F.concat(F.lit("."), expected)))
    rows = rows.withColumn("name_score", name_score).withColumn("address_match", F.coalesce(address_match, F.lit(False)))
    rows = rows.withColumn("town_match", F.coalesce(town_match, F.lit(False))).withColumn(
        "phone_match", F.coalesce(phone_match, F.lit(False))
    )
    rows = rows.withColumn("site_match", F.coalesce(site_match, F.lit(False)))
    rows = with_stage(rows, "_names", F.struct(F.array_join("_target", " ").alias("own"), F.array_join("_title", " ").alias("listed")))
    rows = with_stage(rows, "fuzzy_score", similarity(F.col("_names.own"), F.col("_names.listed")))
    channels = (
        (F.col("address_match") | F.col("town_match")).cast("int") + F.col("phone_match").cast("int") + F.col("site_match").cast("int")
    )
    accepted = (
        ((F.col("name_score") >= 0.99) & (channels >= 1))
        | ((F.col("name_score") >= 0.66) & (channels >= 2))
        | (F.col("site_match") & (F.col("fuzzy_score") >= 0.85))
    )
    generic = (F.size(F.array_distinct("_target")) == 1) & F.try_element_at("_target", F.lit(1)).isin(*GENERIC_PLACE_TOKENS)
    weak = F.coalesce(generic, F.lit(False)) & ~(F.col("address_match") | F.col("phone_match") | F.col("site_match"))
    reviews = F.greatest(F.lit(1), F.coalesce("review_count", F.lit(0)))
    score = (
        F.col("name_score") * 4 + F.col("address_match").cast("int") * 3 + F.col("phone_match").cast("int") * 2
        + F.col("site_match").cast("int") * 3 + F.col("town_match").cast("int") * 2 + F.least(F.lit(1.0), F.log10(reviews) / 5)
    )
    return rows.select(
        *places.columns, F.bround("name_score", 4).alias("name_score"), "address_match", "town_match", "phone_match", "site_match",
        F.bround("fuzzy_score", 4).alias("fuzzy_score"), (accepted & ~weak).alias("accepted"), F.bround(score, 4).alias("score"),
    )


def best_places(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """The one best accepted listing per company; equal best scores of different listings make the company abstain."""
    unique = scored.groupBy("org", "place_id").agg(
        F.max_by(F.struct(*[name for name in scored.columns if name not in ("org", "place_id")]), F.col("score")).alias("_row")
    ).select("org", "place_id", "_row.*")
    ok = unique.filter("accepted")
    best = ok.groupBy("org").agg(F.max("score").alias("_top"))
    top = ok.join(best, "org").filter(F.col("score") == F.col("_top")).groupBy("org").agg(
        F.count(F.lit(1)).alias("_n"), F.min("place_id").alias("place_id"), F.max("score").alias("score")
    )
    single = F.col("_n") == 1
    status = (
        F.when(F.col("_n").isNull(), F.lit("no_exact_match")).when(single, F.lit("exact_match")).otherwise(F.lit("ambiguous_exact_match"))
    )
    return entities.select("org").join(top, "org", "left").select(
        "org", status.alias("status"), F.when(single, F.col("place_id")).alias("place_id"), F.when(single, F.col("score")).alias("score")
    )


def place_observations(chosen: DataFrame, places: DataFrame, reviews: DataFrame, retrieved_at: str) -> DataFrame:
    """Observations of the chosen listing: summary, site, ratings in three forms, and one per rated review.

    ``places`` also holds rating and link; ``reviews`` holds org, place_id, review_id, stars, text and reviewer_id.
    """
    listed = chosen.filter(F.col("status") == "exact_match").select("org", "place_id").join(places, ["org", "place_id"])
    listed = listed.withColumn(
        "_sha", canonical_hash(["place_id", "title", "address", "phone", "website", "rating", "review_count", "link"])
    )
    proof = F.array(F.create_map(F.lit("type"), F.lit("place_listing_identity"))).alias("identity_proof")
    common = [
        F.lit("google_places").alias("platform"), F.col("link").alias("source_url"), F.lit(retrieved_at).alias("retrieved_at"),
        F.col("_sha").alias("content_sha256"), F.lit(True).alias("exact_entity"), proof,
        F.lit("unofficial_api_experiment").alias("acquisition_mode"), F.lit("review_required").alias("rights_status"),
    ]
    rated = (F.col("review_count") > 0) & (F.col("rating") > 0) & (F.col("rating") <= 5)
    kinds = F.array_compact(
        F.array(
            *[
                F.when(
                    condition,
                    F.struct(F.lit(kind).alias("kind"), F.lit(signal).alias("signal"), F.lit(source).alias("source"), F.lit(plan).alias("plan")),
                )
                for condition, kind, signal, source, plan in (
                    (F.lit(True), "place", "place_summary", "public_business_listing", "places_identity_resolution"),
                    (F.coalesce("website", F.lit("")) != "", "company-profile", "company_profile", "public_business_listing", "company_site_identity"),
                    (rated, "review-summary", "review_summary", "customer_review_summary", "places_rating_reviews"),
                    (rated, "profile-metrics", "profile_metrics", "public_business_listing", "social_profile_metrics"),
                    (rated, "buzz", "buzz_metrics", "customer_review_summary", "buzz_peer_normalization"),
                )
            ]
        )
    )
    span = F.concat_ws(
        "; ", "title", "address", "phone", F.concat(F.lit("rating="), F.col("rating").cast("string")),
        F.concat(F.lit("reviews="), F.col("review_count").cast("string")),
    )
    metrics = F.create_map(
        F.lit("rating"), F.col("rating").cast("string"), F.lit("review_count"), F.col("review_count").cast("string"),
        F.lit("place_id"), F.col("place_id"),
    )
    summaries = listed.withColumn("k", F.explode(kinds)).select(
        F.concat_ws("-", F.lit("gmaps"), "k.kind", "org", "place_id").alias("id"), "org", F.col("k.signal").alias("signal_type"),
        *common, F.col("k.source").alias("source_class"), span.alias("evidence_span"), metrics.alias("metrics"),
        F.col("k.plan").alias("strategy"),
    )
    single = listed.select("org", "place_id", "link", "_sha").join(reviews, ["org", "place_id"]).filter(
        (F.col("stars") > 0) & (F.col("stars") <= 5)
    )
    text = F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))
    each = single.select(
        F.concat_ws("-", F.lit("gmaps-review"), "org", "review_id").alias("id"), "org", F.lit("review").alias("signal_type"), *common,
        F.lit("customer_review").alias("source_class"),
        F.coalesce(text, F.concat(F.lit("Explicit customer rating: "), F.col("stars").cast("string"), F.lit("/5"))).alias("evidence_span"),
        F.create_map(F.lit("rating"), F.col("stars").cast("string"), F.lit("review_id"), F.col("review_id")).alias("metrics"),
        F.lit("independent_sentiment").alias("strategy"), review_label(F.col("stars")).alias("sentiment_label"),
        F.lit("explicit_star_rating_v1").alias("sentiment_model_version"), "reviewer_id",
    )
    return conform(summaries, OBSERVATION).unionByName(conform(each, OBSERVATION))


# --- J16: profiles and directories -----------------------------------------------------------------------------

def match_rules(features: DataFrame, rules: dict[str, tuple[str, ...]], output: str = "exact_entity") -> DataFrame:
    """Accept a row when all flags of any rule hold, and name the first rule that did."""
    first = F.lit(None).cast("string")
    for name, flags in reversed(list(rules.items())):
        holds = F.lit(True)
        for flag in flags:
            holds = holds & F.coalesce(F.col(flag), F.lit(False))
        first = F.when(holds, F.lit(name)).otherwise(first)
    return features.withColumn("matched_rule", first).withColumn(output, first.isNotNull())


PROFILE_RULES = {
    "name_and_domain": ("core_name_match", "domain_match"),
    "alias_and_domain": ("alias_match", "domain_match"),
    "full_name_and_location": ("full_name_match", "location_match"),
    "full_name_and_job_link": ("full_name_match", "company_id_job_link"),
    "alias_location_and_leader": ("alias_match", "location_match", "leader_match"),
}
CROSSLINK_RULES = {"exact_name": ("structured_page", "core_name_match"), "reverse_domain": ("structured_page", "domain_match")}


def _core(value: Column) -> Column:
    return F.array_join(F.filter(tokens(value), lambda word: ~word.isin(*CHANNEL_STOP)), " ")


def _full(value: Column) -> Column:
    return F.array_join(tokens(value), " ")


def profile_features(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """Flags of professional-network profiles of a company.

    ``entities``: org, name, municipality, verified_site, leaders (array). ``profiles``: org, page_url, profile_name,
    profile_site, profile_location, profile_text, aliases (array), job_link.
    """
    rows = profiles.join(entities.select("org", "name", "municipality", "verified_site", "leaders"), "org")
    legal, seen = _core(F.col("name")), _core(F.col("profile_name"))
    own, offered = bare_host(F.col("verified_site")), bare_host(F.col("profile_site"))
    place = _full(F.col("municipality"))
    text = _full(F.col("profile_text"))
    alias = F.exists(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda name: (_full(name) == _full(F.col("profile_name"))) | (_core(name) == seen),
    )
    leader = F.exists(F.coalesce("leaders", F.array().cast("array<string>")), lambda name: (_full(name) != "") & F.contains(text, _full(name)))
    return rows.select(
        *profiles.columns,
        (F.coalesce("page_url", F.lit("")) != "").alias("structured_page"),
        ((_full(F.col("name")) != "") & (_full(F.col("name")) == _full(F.col("profile_name")))).alias("full_name_match"),
        ((legal != "") & (legal == seen)).alias("core_name_match"),
        ((own != "") & (own == offered)).alias("domain_match"),
        ((place != "") & F.contains(_full(F.col("profile_location")), place)).alias("location_match"),
        F.coalesce("job_link", F.lit(False)).alias("company_id_job_link"),
        F.coalesce(alias, F.lit(False)).alias("alias_match"),
        F.coalesce(leader, F.lit(False)).alias("leader_match"),
    )


def exact_directory_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Directory pages that name both the company and its number (org, text): the page is about that company."""
    rows = pages.join(entities.select("org", "name"), "org")
    named = F.contains(squash_lower(F.col("text")), squash_lower(F.col("name")))
    return rows.withColumn("exact_entity", named & F.contains(digits(F.col("text")), F.col("org"))).select(*pages.columns, "exact_entity")


# --- W19: channels -----------------------------------------------------------------------------------------------

def channel_name(value: Column) -> Column:
    words = F.regexp_extract_all(fold(value), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(words, lambda word: ~word.isin(*CHANNEL_STOP)), " ")


def pick_channels(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Video channel per company: exact name, most hits, then address; accepted on two hits or its own domain in a text.

    ``entities``: org, name, verified_site. ``hits``: org, channel_url, channel_name, description.
    """
    named = hits.join(entities.select("org", "name", "verified_site"), "org").filter(
        (F.coalesce("channel_url", F.lit("")) != "") & (channel_name(F.col("channel_name")) == channel_name(F.col("name")))
    )
    site = bare_host(F.col("verified_site"))
    mentioned = (site != "") & F.contains(F.lower(F.coalesce("description", F.lit(""))), site)
    counted = named.groupBy("org", "channel_url").agg(
        F.count(F.lit(1)).alias("hits"), F.bool_or(F.coalesce(mentioned, F.lit(False))).alias("domain_mentioned")
    )
    best = counted.groupBy("org").agg(
        F.min_by(F.struct("channel_url", "hits", "domain_mentioned"), F.struct(-F.col("hits"), F.col("channel_url"))).alias("c")
    )
    accepted = (F.col("c.hits") >= 2) | F.col("c.domain_mentioned")
    return entities.select("org").join(best, "org", "left").select(
        "org", F.when(accepted, F.col("c.channel_url")).alias("channel_url"), F.col("c.hits").alias("hits"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )
