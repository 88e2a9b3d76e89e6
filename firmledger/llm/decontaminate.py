"""Benchmark decontamination by template canonicalisation (operator 6).

Texts become token templates: numbers, names (capitalised words inside a sentence) and units after a number turn into typed
placeholders, all else is lower case; punctuation is dropped. Neighbouring numbers (``1,200``, ``2.50``) and neighbouring names
(``Mary Ann``) are one placeholder. Windows of ``WINDOW`` template tokens of the documents are
joined by hash with those of the benchmark, so a question asked anew with other numbers or names still meets its item. Beside
them, in the same join, stand windows of the plain lower-cased tokens: they do not depend on case, line breaks or what precedes a
word, so whatever is quoted word for word is found, also items that are all numbers or names. The first word of an item may be
a name or not, depending on what it is quoted after: an item is held against both readings. What a
slot holds then has to be consistent: within a run of windows a value of the item that was changed stands for one value of the
document. Values left as they are never conflict, and two values may become the same one. A document is contaminated where a
consistent run of windows of one item covers at least ``COVER`` tokens, or the whole of a shorter item; a conflict ends a run but
does not spoil the windows before or after it. The windows of a run follow each other in item and document; between two of them,
words may have come in or gone, at most as many as the item has.

The work is two array columns and a join: Spark makes one array of token hashes with their kinds, a numpy step turns it into
windows and drops those whose hash no benchmark window has, and the remaining windows, with their slots, are joined with the
benchmark table. That filter is a table of bits built from the benchmark's hashes; beyond ``FILTER_WINDOWS`` windows there is
no filter and all windows are joined instead. Template windows with fewer than ``LITERALS`` literal tokens say too little and are left
out on both sides; such passages are found by their plain windows only, word for word.

Documents are told apart by their text, so copies are joined once. Null or empty texts and items match nothing.
Repeated rows get equal verdicts; repeated items count once; extra columns are ignored; an empty table on either side gives no match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, LITERALS, COVER = 8, 5, 13
EXACT = 64  # seed that keeps the hashes of plain windows apart
FILTER_WINDOWS = 5_000_000
SLICE_TOKENS = 500_000
# Units that may follow a number.
UNITS = (
    "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters s sec second "
    "seconds min minute minutes h hr hour hours day days week weeks month months year years percent usd eur gbp dollar dollars "
    "euro euros cent cents degrees kmh mph hz khz mhz ghz kb mb gb tb w kw v"
).split()
_NUMBER, _NAME, _UNIT = 1, 2, 3
_MARK = "\u0001"
_BLANK = r"[\s\p{Z}]"


def _key(text: Column) -> Column:
    """Key of a text, for copies to be searched once; null where it is null or blank."""
    return F.when(F.trim(text) != "", F.unhex(F.md5(text)))


def tokens(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``tokens``: a hash per token whose two low bits name its kind (literal, number, name, unit)."""
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(_MARK), F.lit(" "))
    # Begins at the first white space after a word, so few places are looked at.
    marked = F.regexp_replace(text, rf"{_BLANK}(?<=[\p{{Ll}}\p{{Nd}},;]{_BLANK}){_BLANK}*+(?=\p{{Lu}}\p{{Ll}})", f" {_MARK}")
    rows = rows.withColumn("_tokens", F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}\p{{M}}\p{{N}}{_MARK}]+"), ""))
    units = F.array(*map(F.lit, UNITS))

    def kind(token, at):
        # Digits sort before letters and the mark before digits, so comparing strings tells the kinds.
        before = F.get("_tokens", at - 1)
        unit = (at > 0) & (before < ":") & (before > "\u0002") & F.array_contains(units, token)
        return F.when(token < "\u0002", _NAME).when(token < ":", _NUMBER).when(unit, _UNIT).otherwise(0)

    plain = lambda token: F.when(token < "\u0002", F.substring(token, 2, 2**31 - 1)).otherwise(token)
    coded = F.transform("_tokens", lambda token, at: F.xxhash64(plain(token)).bitwiseAND(F.lit(-4)).bitwiseOR(kind(token, at).cast("bigint")))
    return rows.withColumn("tokens", coded).drop("text", "_tokens")


def windows(coded: np.ndarray, sizes: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` tokens that hold enough literals, with their document and first token."""
    many = np.maximum(sizes - width + 1, 0)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), many)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = starts[doc] + first
    kinds = (coded & 3).astype(np.int64)
    shape = np.where(kinds == 0, coded, kinds).astype(np.int64).view(np.uint64)
    literal = np.append(0, np.cumsum(kinds == 0))
    out = np.full(len(doc), width + seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ shape[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    enough = literal[at + width] - literal[at] >= min(LITERALS, width)
    return out.view(np.int64)[enough], doc[enough], first[enough]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``SLICE_TOKENS`` tokens, one document at least: bounds what a step holds at once."""
    for batch in batches:
        slices = batch.column(1).offsets.to_numpy() // SLICE_TOKENS
        edges = [0, *(np.flatnonzero(np.diff(slices[:-1])) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end > start:
                yield batch.slice(start, end - start)


def matches(rows: DataFrame, widths: list[tuple[bool, int]] | None, known: np.ndarray | None) -> DataFrame:
    """Windows of ``rows(key, tokens)``, of the given kinds and widths; without them, those of benchmark items.

    key, plain_size, size (tokens of the text, plain and as a template), hash, width, plain (first plain token; null for template
    windows), first, end (in the template), slots. ``known`` filters them by the benchmark's hashes.
    """
    bits = None
    if known is not None:
        bits = np.zeros(1 << 24, bool)
        bits[known & 0xFFFFFF] = True
        known = np.unique(known)
    held = rows.sparkSession.sparkContext.broadcast((bits, known))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value
        for batch in sliced(batches):
            lists = batch.column(1)
            coded, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            plain_starts = np.cumsum(sizes) - sizes
            folded, folded_sizes, place = template(coded, sizes)
            starts = np.cumsum(folded_sizes) - folded_sizes
            for exact, width in widths or [(e, w) for e in (True, False) for w in range(1, WINDOW + 1)]:
                hashes, doc, first = windows(coded & -4, sizes, width, EXACT) if exact else windows(folded, folded_sizes, width)
                if widths is None:
                    own = np.flatnonzero(np.minimum((sizes if exact else folded_sizes)[doc], WINDOW) == width)
                    hashes, doc, first = hashes[own], doc[own], first[own]
                if bits is not None:
                    some = np.flatnonzero(bits[hashes & 0xFFFFFF])
                    some = some[known[np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)] == hashes[some]] if len(known) else some[:0]
                    hashes, doc, first = hashes[some], doc[some], first[some]
                if len(hashes):
                    if exact:
                        at = plain_starts[doc] + first
                        plain, low, high, slots = pa.array(first), place[at], place[at + width - 1] + 1, [[]] * len(first)
                    else:
                        kept = folded[(starts[doc] + first)[:, None] + np.arange(width)]
                        plain, low, high, slots = pa.nulls(len(first), pa.int64()), first, first + width, [row[(row & 3) != 0].tolist() for row in kept]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(doc)), pa.array(sizes[doc]), pa.array(folded_sizes[doc]), pa.array(hashes),
                            pa.array(np.full(len(first), width)), plain, pa.array(low), pa.array(high), pa.array(slots, pa.list_(pa.int64())),
                        ],
                        ["key", "plain_size", "size", "hash", "width", "plain", "first", "end", "slots"],
                    )

    shape = "key binary, plain_size bigint, size bigint, hash bigint, width bigint, plain bigint, first bigint, end bigint, slots array<bigint>"
    return rows.select("key", "tokens").mapInArrow(find, shape)


def template(coded: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of documents given as concatenated tokens, their number in each, and the template token of each token."""
    kinds = coded & 3
    doc = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(coded), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0) | (kinds[1:] == _UNIT) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return coded, sizes, coded
    # The value of a run of one token is that token; further tokens are mixed in by their place in the run.
    group = np.cumsum(new) - 1
    place = (np.arange(len(coded)) - at[group]).astype(np.uint64)
    with np.errstate(over="ignore"):
        more = (coded.view(np.uint64) ^ (place * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x9E3779B97F4A7C15)
        more ^= more >> np.uint64(29)
        values = np.add.reduceat(np.where(new, coded.view(np.uint64), more), at)
    folded = (values.view(np.int64) & -4) | kinds[at]
    folded_sizes = np.bincount(doc[at], minlength=len(sizes)).astype(np.int64)
    first = np.cumsum(folded_sizes) - folded_sizes
    return folded, folded_sizes, group - first[doc]


def coverage(found: list[tuple], length: int) -> int:
    """Most tokens of an item of ``length`` tokens that a consistent run of windows covers; 0 where they are too few.

    ``found`` holds (first, end) in the document, (first, end) in the item and the changed slots as (item value, document value).
    """
    found = sorted(found, key=lambda w: (w[0], w[2], w[1]))
    seen: set[int] = set()
    for _, _, low, high, _ in found:
        seen.update(range(low, high))
    if len(seen) < min(length, COVER):
        return 0
    same: dict[int, set[int]] = {}
    for first, _, low, high, changed in found:
        if not changed:
            same.setdefault(first - low, set()).update(range(low, high))
    if any(len(own) >= length for own in same.values()):
        return length
    total, begin, before, gain = [], [], [], []
    for j, (first, end, low, high, changed) in enumerate(found):
        width = min(end - first, high - low)
        options = []
        for i in range(j - 1, -1, -1):
            first_i, end_i, low_i, high_i, _ = found[i]
            if first - first_i > 2 * length:
                break
            if low_i <= low and abs(first - low - first_i + low_i) <= length:
                new = min(high - max(low, high_i), end - max(first, end_i))
                if new > 0:
                    options.append((total[i] + new, new, i))
        best = (width, j, -1, width)
        for bound, new, i in sorted(options, key=lambda o: (-o[0], -o[2])):
            if bound <= best[0]:
                break
            # Walk back until a changed value meets another change of the same value: the run begins after that.
            start, sum_, k = begin[i], bound, i
            if changed:
                values, sum_, last = dict(changed), new, -1
                while True:
                    if any(values.setdefault(a, b) != b for a, b in found[k][4]):
                        start = last
                        break
                    last = k
                    if k == begin[i]:
                        break
                    sum_, k = sum_ + gain[k], before[k]
                if last < 0:
                    continue
                # The first window of a run counts whole.
                own = min(found[last][1] - found[last][0], found[last][3] - found[last][2])
                sum_ += own if last == begin[i] else own - gain[last]
            if sum_ > best[0]:
                best = (sum_, start, i, new)
        for values, value in zip((total, begin, before, gain), best, strict=True):
            values.append(value)
    most = max(total, default=0)
    return most if most >= min(length, COVER) else 0


def changes(old: list[int], new: list[int]) -> list[tuple] | None:
    """Changed slots of a window; null where the window itself changes one value in two ways."""
    pairs = {(a, b) for a, b in zip(old, new, strict=True) if a != b}
    return None if len({a for a, _ in pairs}) < len(pairs) else sorted(pairs)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            plain, found = [], []
            for w in row["windows"]:
                changed = changes(w["item_slots"], w["slots"])
                if changed is not None:
                    found.append((w["first"], w["end"], w["item_first"], w["item_end"], changed))
                if w["plain"] is not None:
                    plain.append((w["plain"], w["plain"] + w["width"], w["item_plain"], w["item_plain"] + w["width"], []))
            most = coverage(plain, row["plain_size"])
            if most < row["plain_size"]:
                most = max(most, coverage(found, row["size"]))
            if most:
                out.append((row["key"], row["item_id"], most))
        if out:
            keys, ids, covered = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(covered, pa.int64())], ["key", "item_id", "covered"])


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of all benchmark items, shorter items as one window, with the first word read as it stands and as after another word."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = tokens(rows.withColumn("_text", F.col("text"))).withColumnsRenamed({"tokens": "alone", "_text": "text"})
    rows = tokens(rows.withColumns({"_text": F.col("text"), "text": F.concat(F.lit("a "), F.ltrim(F.coalesce("text", F.lit(""))))}))
    after = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    rows = rows.select("item_id", "_text", F.explode(F.array_distinct(F.array("alone", after))).alias("tokens"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("|", "item_id", "_text", F.array_join(F.col("tokens").cast("array<string>"), " ")))))
    rows = cut(rows.select("item_id", "key", "tokens"), "items")
    found = matches(rows, None, None).join(rows.select("key", "item_id"), "key")
    renamed = found.select("item_id", F.col("key").alias("item"), "plain_size", "size", "hash", "width", *[F.col(c).alias(f"item_{c}") for c in ("plain", "first", "end", "slots")])
    return cut(renamed, "item-windows")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contaminated word sequences: key, item_ids (array), covered (most tokens of one run)."""
    texts = docs.select(F.col("text").cast("string").alias("text")).select(_key(F.col("text")).alias("key"), "text").where("key IS NOT NULL")
    asked = item_windows(items)
    widths = [tuple(row) for row in asked.select(F.col("item_plain").isNotNull(), "width").distinct().collect()]  # at most twice WINDOW
    known = None
    if asked.select("hash").distinct().count() <= FILTER_WINDOWS:  # bounds what the driver and the tasks hold
        known = np.array([row[0] for row in asked.select("hash").distinct().toLocalIterator()], dtype=np.int64)
    found = matches(tokens(texts), widths or [(True, WINDOW)], known).drop("plain_size", "size")
    found = cut(found, "windows").dropDuplicates(["key", "plain", "first", "width"])
    pairs = found.join(asked, ["hash", "width"]).where(F.size("slots") == F.size("item_slots"))
    # One item in one text: at most as many windows as the text has at each of the item's.
    fields = [f"{side}{c}" for side in ("", "item_") for c in ("plain", "first", "end", "slots")]
    paired = pairs.groupBy("key", "item", "item_id", "plain_size", "size").agg(F.collect_list(F.struct("width", *fields)).alias("windows"))
    kept = paired.select("key", "item_id", "plain_size", "size", "windows").mapInArrow(_judge, "key binary, item_id bigint, covered bigint")
    return kept.groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"))


def benchmark_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids, covered."""
    rows = docs.select("doc_id", _key(F.col("text").cast("string")).alias("key"))
    return rows.join(contaminated(docs, items), "key", "left").select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
    )


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a benchmark leak, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), _key(F.col("text").cast("string")).alias("_key"))
    leaks = contaminated(docs, items).select(F.col("key").alias("_key"))
    return rows.join(leaks, "_key", "left_anti").select("_row.*")
