"""Base counts and distribution-divergence rules (operator 2), native columns only.

The base counts state how long, how repetitive and how full of signs a text is. The divergence verdict compares two histograms
of a document with those of its language, by Jensen-Shannon distance (base 2, so 0 to 1):

- character classes of the words: lower case and all else, upper case, digits, sentence signs, markup signs;
- common words of the language, everything else being one more bin. Words are looked up as written.

The references are means over all documents of the language, found in a first pass; a language without a common-word list uses
one shared reference, so there are at most as many references as lists and one, and they are broadcast. Short documents say
too little: below ``MIN_CHARS`` or ``MIN_WORDS`` the respective distance is not judged, and above that the limit narrows with
the length.

A null text has no words and fails the base rule. A null or unknown language is judged against the shared reference. Every row
is judged on its own, so repeated rows and clashing extra columns do not matter; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import with_stage
from .common import WHITE, cut, words

# The most common words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that it was for on with".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y a los se del las un".split(),
}
OTHER = "other"
MIN_CHARS, MIN_WORDS = 200, 50
# A limit is the first number plus the second over the root of the length: the distance of a sample shrinks that way.
CHAR_DISTANCE, WORD_DISTANCE = (0.15, 2.6), (0.17, 0.85)
WINDOW = 5
_BINS = 1 + max(map(len, COMMON_WORDS.values()))


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _matching(text: Column, pattern: str) -> Column:
    """How many characters of a text match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{pattern}]+", ""))


def with_histograms(docs: DataFrame) -> DataFrame:
    """Add word_chars, n_symbols and the two histograms ``_chars`` and ``_common`` to rows with text and lang."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"_text": text, "_lang": _language(F.col("lang"))}).withColumn("_words", words(F.col("_text")))
    counts = {
        "word_chars": F.length(F.regexp_replace("_text", WHITE, "")),
        "n_symbols": _matching(F.col("_text"), "#*$%&|<>"),
        "_upper": _matching(F.col("_text"), r"\p{Lu}"),
        "_digits": _matching(F.col("_text"), r"\p{Nd}"),
        "_marks": _matching(F.col("_text"), r".,;:!?'()\"\-"),
    }
    rows = rows.withColumns(counts)
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("_upper") - F.col("_digits") - F.col("_marks")
    # One array_remove per common word: compiled loops without a lambda.
    listed = F.lit(None).cast("array<string>")
    for code, known in COMMON_WORDS.items():
        listed = F.when(F.col("_lang") == code, F.array(*map(F.lit, known))).otherwise(listed)
    rows = rows.withColumn("_listed", listed)
    found = [F.coalesce(F.size("_words") - F.size(F.array_remove("_words", F.get("_listed", F.lit(k)))), F.lit(0)) for k in range(_BINS - 1)]
    rows = rows.withColumn("_found", F.when(F.col("_listed").isNotNull(), F.array(*found)).otherwise(F.array(*[F.lit(0)] * (_BINS - 1))))
    others = F.size("_words") - F.aggregate("_found", F.lit(0), lambda total, n: total + n)
    return rows.withColumns(
        {
            "_chars": F.array(rest, "_upper", "_digits", "_marks", "n_symbols").cast("array<double>"),
            "_common": F.concat(F.array(others), "_found").cast("array<double>"),
        }
    ).drop("_upper", "_digits", "_marks", "_listed", "_found")


def references(docs: DataFrame) -> DataFrame:
    """Mean histograms of all documents of each listed language, and of the rest together: a handful of rows.

    Every document that is long enough to be judged weighs the same, so a very long one does not set the standard.
    """
    rows = with_histograms(docs.select("text", "lang")).withColumn("_n", F.size("_words"))
    rows = rows.where((F.col("word_chars") >= MIN_CHARS) & (F.col("_n") >= MIN_WORDS))
    means = {f"c{k}": F.avg(F.col("_chars")[k] / F.col("word_chars")) for k in range(5)}
    means |= {f"w{k}": F.avg(F.col("_common")[k] / F.col("_n")) for k in range(_BINS)}
    means = rows.groupBy("_lang").agg(*[value.alias(name) for name, value in means.items()])
    return means.select(
        "_lang",
        F.array(*[f"c{k}" for k in range(5)]).alias("_ref_chars"),
        F.array(*[f"w{k}" for k in range(_BINS)]).alias("_ref_common"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def with_distance(rows: DataFrame, name: str, counts: str, reference: str) -> DataFrame:
    """Add the Jensen-Shannon distance of two histograms; 0 where one of them is missing or empty."""

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    rows = with_stage(rows, "_totals", F.struct(_sum(F.col(counts)).alias("own"), _sum(F.col(reference)).alias("ref")))
    own, ref = F.col("_totals.own"), F.col("_totals.ref")
    both = F.zip_with(counts, reference, lambda c, r: F.struct((c / own).alias("p"), (r / ref).alias("q")))
    parts = F.transform(both, lambda x: term(x["p"], x["q"]) + term(x["q"], x["p"]))
    far = F.sqrt(F.greatest(_sum(parts) / 2, F.lit(0.0)))
    return with_stage(rows, name, F.when((own > 0) & (ref > 0), far).otherwise(F.lit(0.0)))


def _windows(found: Column) -> Column:
    """Hashes of all five-word windows in order."""
    return F.transform(
        F.when(F.size(found) >= WINDOW, F.sequence(F.lit(0), F.size(found) - WINDOW)).otherwise(F.array().cast("array<int>")),
        lambda at: F.xxhash64(*[F.get(found, at + k) for k in range(WINDOW)]),
    )


def with_base_counts(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows with histograms.

    Repeated words lie in a five-word window that occurs at least twice: window hashes are sorted with their places, equal
    neighbours are repeats, and the repeats' places, in order, cover up to five words each. Texts without a repeat are told
    by their number of distinct hashes.
    """
    rows = rows.withColumns(
        {
            "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]")),
            "_hashes": _windows(F.col("_words")),
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.col("word_chars").cast("bigint"),
            "n_symbols": F.col("n_symbols").cast("bigint"),
        }
    )
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_repeats": F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.col("_hashes")),
        }
    )
    rows = with_stage(rows.drop("_text", "_words", "_lines", "_hashes"), "_ranked", F.sort_array(
        F.transform("_repeats", lambda h, at: F.struct(h.alias("h"), at.alias("at")))
    ))
    same = lambda x, k: x["h"].eqNullSafe(F.get("_ranked", k - 1)["h"]) | x["h"].eqNullSafe(F.get("_ranked", k + 1)["h"])
    rows = with_stage(rows, "_places", F.sort_array(F.transform(F.filter("_ranked", same), lambda x: x["at"])))
    after = lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - at, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("_places", after), F.lit(0), lambda total, n: total + n)
    rows = with_stage(rows, "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    return rows.drop("_repeats", "_ranked", "_places")


def judged(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents with base counts, both distances, base_failed and kept; ``docs`` needs text and lang."""
    rows = with_base_counts(with_histograms(docs))
    rows = rows.join(F.broadcast(refs), "_lang", "left")  # at most one row per listed language and one
    rows = with_distance(rows, "char_distance", "_chars", "_ref_chars")
    rows = with_distance(rows, "word_distance", "_common", "_ref_common")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    char_limit = CHAR_DISTANCE[0] + CHAR_DISTANCE[1] / F.sqrt(F.col("word_chars"))
    word_limit = WORD_DISTANCE[0] + WORD_DISTANCE[1] / F.sqrt(F.col("n_words"))
    char_ok = (F.col("word_chars") < MIN_CHARS) | (F.col("char_distance") <= char_limit)
    word_ok = (F.col("n_words") < MIN_WORDS) | (F.col("word_distance") <= word_limit)
    # Behind a stage, so that a filter on the verdict does not work out the counts a second time.
    return with_stage(rows.withColumn("base_failed", failed), "kept", ~F.col("base_failed") & char_ok & word_ok)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and both distances."""
    refs = cut(references(docs), "quality-references")
    return judged(docs.select("doc_id", "text", "lang"), refs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"
    )


def keep(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns."""
    refs = cut(references(docs), "quality-references")
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    return judged(rows, refs).where("kept").select("_row.*")
