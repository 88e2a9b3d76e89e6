"""ProbMinHash near-duplicate classes (operator 5).

Documents are sets of five-word shingles. A ProbMinHash signature keeps,
in each of ``ROWS * BANDS`` registers, the shingle of the earliest arrival of a Poisson process whose rate is the weight: two
signatures agree in a register with the probability Jaccard similarity of the documents. Arrivals are drawn in rounds for all
documents of an Arrow batch at once, and a shingle stops as soon as its next arrival is later than every register of its
document. Every distinct shingle has weight 1 here, so that registers agree with the very similarity that decides: weights by number
of occurrences would keep texts apart that repeat a passage differently. Bands of registers then propose pairs, and exact Jaccard similarity of the shingle sets decides (0.8 or more).

Equal word sequences are one node, so thousands of copies cost one row. Inside a band bucket nodes are held against leaders,
not against each other:

1. Every node is verified against one leader, the heaviest node of all its buckets (see ``linked``). Connected components of the verified links
   are found by label propagation over written tables.
2. Buckets whose members lie in several components stay open. Twice their members are held against the heaviest member outside
   the bucket's largest component; components are renewed each time, and most buckets close.
3. What is still open is settled exactly by differences. Every member is held against one hub, the heaviest node of the components
   its bucket lies in, and keeps the shingles that only one of the two has. Two members differ in as many shingles as they do from
   the hub together, less twice the differences that they share; one that is not linked to the hub (far) can so be linked only to
   members that share more than half of their differences with it. These are found through their rarest differences (a prefix
   filter with positions, no cap) and verified; two members linked to the hub are in one class anyway. Copies changed at random
   places share few differences, so a large group yields few pairs. After that no pair of a bucket can be a link that was missed.

Texts of fewer than five words have one shingle, all their words. Null texts and texts without words are classes of their own
(never linked). class_id is the smallest doc_id of the class, null ids counting only where no other exists. Repeated rows
belong to one class; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_key, words

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit numbers (finaliser of a splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word windows of documents given as concatenated word hashes; and the document of each."""
    many = np.maximum(sizes - SHINGLE + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), many)
    at = starts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    last, out = starts + sizes, np.zeros(len(doc), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            inside = at + k < last[doc]
            word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(inside, _mix(out * np.uint64(_M1) + word + np.uint64(k + 1)), out)
    return out, doc


def signatures(shingles: np.ndarray, doc: np.ndarray, docs: int, registers: int, weighted: bool = True) -> np.ndarray:
    """ProbMinHash signatures of all documents: a table documents x registers of shingle hashes.

    The weight of a shingle is how often it occurs, or 1 where not ``weighted``.
    """
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(shingles))).astype(float) if weighted else np.ones(len(at))
    element, owner = shingles[at], doc[at]
    best_time = np.full(docs * registers, np.inf)
    best = np.zeros(docs * registers, np.uint64)
    state, time = element.copy(), np.zeros(len(element))
    alive = np.arange(len(element))
    with np.errstate(over="ignore"):
        while len(alive):
            state[alive] = _mix(state[alive] + np.uint64(_M1))
            draw = state[alive]
            time[alive] += -np.log(((draw >> np.uint64(11)).astype(float) + 1) / 2**53) / weight[alive]
            register = (_mix(draw ^ np.uint64(_M2)) % np.uint64(registers)).astype(np.int64) + owner[alive] * registers
            arrival = time[alive]
            early = arrival < best_time[register]
            mine, when, where = alive[early], arrival[early], register[early]
            np.minimum.at(best_time, where, when)
            won = best_time[where] == when
            best[where[won]] = element[mine[won]]
            latest = best_time.reshape(docs, registers).max(axis=1)
            alive = alive[arrival < latest[owner[alive]]]
    return best.reshape(docs, registers)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            out = _mix(out * np.uint64(_M1) + signature[:, row::ROWS][:, :BANDS])
        out = _mix(out + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_M2))
    return out.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            own = batch.slice(part, 512)
            lists = own.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            hashes, doc = shingle_hashes(flat, sizes)
            bands = band_hashes(signatures(hashes, doc, len(sizes), BANDS * ROWS, weighted=False))
            offsets = pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [own.column(0), pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1)))], ["key", "bands"]
            )


def with_shingles(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by its distinct five-word shingles, as hashes, for verification."""
    rows = rows.withColumn("_words", words("text"))
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_words") - SHINGLE, F.lit(0))),
        lambda at: F.xxhash64(F.slice("_words", at + 1, F.lit(SHINGLE))),
    )
    return rows.withColumn("shingles", F.array_distinct(each)).drop("text", "_words")


def nodes_of(texts: DataFrame) -> DataFrame:
    """Distinct word sequences of ``texts(key, text)`` with a number and the hashes of their bands: key, id, bands."""
    hashed = texts.select("key", F.transform(words("text"), lambda word: F.xxhash64(word)).alias("hashes"))
    banded = hashed.mapInArrow(_bands, "key binary, bands array<bigint>")
    # Copies have equal bands: one row of each key is enough, and rows are combined before the shuffle.
    return cut(banded.groupBy("key").agg(F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "nodes")


def components(links: DataFrame) -> DataFrame:
    """Smallest id of the connected component of every linked id: id, label.

    Each round an id takes the smallest label among its neighbours and then the label of that label, so paths halve; an id
    with many links is combined before the shuffle. Rounds are written tables.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both-ways")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "step").select("id", "old", F.least("step", "far").alias("label")), "labels")
        labels = moved.select("id", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``SIMILAR``."""
    left, right = (shingles.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    rows = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return rows.where(shared >= SIMILAR * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def linked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component label of every node that has a link: id, label."""
    every = nodes.select("id", F.explode("bands").alias("bucket"))
    counts = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(every.join(counts, "bucket"), "buckets")
    # A node's weight is how many nodes its buckets hold: the text that a group was copied from outweighs its copies.
    weights = rows.groupBy("id").agg(F.sum("n").alias("weight"))
    rows = cut(rows.drop("n").join(weights, "id"), "weighed-buckets")
    heads = rows.groupBy("bucket").agg(F.max_by("id", F.struct("weight", "id")).alias("a"), F.max("weight").alias("top"))
    rows = cut(rows.join(heads, "bucket"), "led-buckets")
    members = rows.select("id").distinct().join(nodes.select("id", "key"), "id")
    candidates = texts.join(members, "key").groupBy("id").agg(F.first("text").alias("text"))
    shingles = cut(with_shingles(candidates), "shingles")
    # First each node against one leader, the heaviest of all its buckets: most classes are whole after that.
    pairs = rows.groupBy("id").agg(F.max_by("a", F.struct("top", "a")).alias("head")).where("id <> head")
    pairs = pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    links = cut(verified(pairs, shingles), "links")
    labels, rows = components(links), rows.select("bucket", "id", "weight")
    for _ in range(2):
        open_ = open_buckets(rows, labels)
        if open_.isEmpty():
            return labels
        heads = _outside(open_).groupBy("bucket").agg(F.max_by("head", F.struct("weight", "head")).alias("head"), F.max_by("other", F.struct("weight", "head")).alias("other"))
        links, labels = more_links(open_, heads, shingles, links)
        rows = open_
    open_ = open_buckets(rows, labels)
    if open_.isEmpty():
        return labels
    return settled(open_, shingles, links)


def differences(rows: DataFrame, shingles: DataFrame) -> DataFrame:
    """Members of open buckets against the hub of their bucket: hub, id, label, size, hub_size, apart (shingles of only one of both).

    The hub of a component is its heaviest node, that of a bucket the heaviest one of its components; it need not be a member.
    """
    hubs = rows.groupBy("label").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"), F.max("weight").alias("top"))
    held = rows.select("bucket", "label").distinct().join(hubs, "label").groupBy("bucket").agg(F.max_by("hub", F.struct("top", "hub")).alias("hub"))
    own = rows.join(held, "bucket").where("id <> hub").select("hub", "id", "label").distinct()
    both = own.join(shingles, "id").join(shingles.select(F.col("id").alias("hub"), F.col("shingles").alias("others")), "hub")
    apart = F.concat(F.array_except("shingles", "others"), F.array_except("others", "shingles"))
    return cut(both.select("hub", "id", "label", F.size("shingles").alias("size"), F.size("others").alias("hub_size"), apart.alias("apart")), "differences")


def possible_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one hub that can be linked, but for those that are both linked to the hub.

    Sets of m and n shingles are similar exactly if they differ in (m + n) / 9 shingles at most, and they differ in
    ``parts`` of both less twice the shared ones. ``rest`` counts the differences from one on, rarest first: what two members
    can still share from their first common difference on.
    """
    members = members.withColumn("parts", F.size("apart")).withColumn("far", 9 * F.col("parts") > F.col("size") + F.col("hub_size"))
    # More than ``half`` of 18 shared differences each, or there is no link to any far member.
    members = members.withColumn("half", 9 * F.col("parts") + F.col("hub_size") - F.col("size")).where(F.col("far") | (18 * F.col("parts") > F.col("half")))
    each = members.withColumn("part", F.explode("apart")).drop("apart", "hub_size")
    several = each.groupBy("hub", "part").agg(F.count("*").alias("n")).where("n > 1")
    order = Window.partitionBy("hub", "id").orderBy(F.desc("n"), F.desc("part"))
    ranked = cut(each.join(several, ["hub", "part"]).withColumn("rest", F.row_number().over(order)).drop("n"), "ranked-differences")
    left = ranked.where("far").select("hub", "part", *(F.col(c).alias(f"far_{c}") for c in ("id", "label", "size", "parts", "rest")))
    right = ranked.where(18 * F.col("rest") > F.col("half"))
    shared = 18 * F.least("rest", "far_rest") >= 9 * (F.col("parts") + F.col("far_parts")) - F.col("size") - F.col("far_size")
    found = right.join(left, ["hub", "part"]).where((F.col("label") != F.col("far_label")) & shared)
    return found.select(F.least("id", "far_id").alias("a"), F.greatest("id", "far_id").alias("b")).distinct()


def settled(rows: DataFrame, shingles: DataFrame, links: DataFrame) -> DataFrame:
    """Component labels after all links inside open buckets are found: id, label."""
    members = differences(rows, shingles)
    near = members.where(9 * F.size("apart") <= F.col("size") + F.col("hub_size"))
    near = near.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    return components(cut(links.union(near).union(verified(possible_pairs(members), shingles)), "links"))


def _outside(rows: DataFrame) -> DataFrame:
    """Members outside the largest component of their bucket: bucket, head, other, weight."""
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    rows = rows.join(largest, "bucket").where("label <> largest")
    return rows.select("bucket", F.col("id").alias("head"), F.col("label").alias("other"), "weight")


def open_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that lie in several components: bucket, id, weight, label."""
    named = rows.select("bucket", "id", "weight").join(labels, "id", "left").select("bucket", "id", "weight", F.coalesce("label", "id").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return cut(named.join(several.select("bucket"), "bucket"), "open-buckets")


def more_links(rows: DataFrame, heads: DataFrame, shingles: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verify members against the heads of their bucket in other components; return all links and the new labels."""
    pairs = rows.drop("weight").join(heads, "bucket").where("label <> other")
    pairs = pairs.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    links = cut(links.union(verified(pairs, shingles)), "links")
    return links, components(links)


def classes(docs: DataFrame) -> DataFrame:
    """One row per word sequence that a document has: key, class_id (smallest doc_id of its class), class_key (its sequence)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", "text", word_key("text").alias("key")).where("key IS NOT NULL")
    nodes = nodes_of(texts.select("key", "text"))
    labels = linked(texts.select("key", "text"), nodes)
    first = texts.groupBy("key").agg(F.min("doc_id").alias("first"))
    named = nodes.select("key", "id").join(first, "key").join(labels, "id", "left").select("key", "first", F.coalesce("label", "id").alias("label"))
    named = cut(named, "named")
    best = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", F.hex("key").alias("key"))).alias("best"))
    return cut(
        named.join(best, "label").select("key", F.col("best.first").alias("class_id"), F.unhex("best.key").alias("class_key")), "classes"
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, kept (the class's one representative; every copy of its text and id)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), word_key(F.col("text").cast("string")).alias("key"))
    rows = rows.join(classes(docs), "key", "left")
    alone = F.col("key").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))).alias("kept"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns; documents without words all stay."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), word_key(F.col("text").cast("string")).alias("_key"))
    chosen = classes(docs).where("key = class_key").select(F.col("key").alias("_key"), F.col("class_id").alias("_class"))
    found = rows.where("_key IS NOT NULL").join(chosen, "_key").where("_id <=> _class")
    return found.groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*").union(rows.where("_key IS NULL").select("_row.*"))
