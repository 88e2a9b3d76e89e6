"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 7).

The statistics are column expressions over the whole text; none of them is a label, a language, a source or an id. Trees are
grown on the driver from a sample of labelled rows that is bounded by ``SAMPLE_ROWS`` (those with the smallest hashes of their
id, so the sample is the same at every run), never from rows of the held-out fold. The forest is flattened into arrays of
feature, cut, child and value, and Arrow batches of statistics walk all trees level by level in numpy.

A null text counts as empty; empty texts get a score like any other. Labels that are null, repeated with different values, or
of unknown documents do not teach. Repeated documents get equal scores; clashing extra columns are passed through untouched.
Without any label, or with one class only, the score is the share of label 1 (0.5 without labels). An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import with_stage
from .common import WHITE, words

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.15, 20, 1.0
ACCEPT = 0.7


def _matching(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{pattern}]+", ""))


def with_statistics(docs: DataFrame, name: str = "_statistics") -> DataFrame:
    """Add an array of statistics of the column ``text``, as double."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns({"_words": words(F.col("_text")), "_lines": F.split("_text", "\n")})
    rows = rows.withColumns(
        {
            "_chars": F.length("_text"),
            "_bare": F.length(F.regexp_replace("_text", WHITE, "")),
            "_n": F.size("_words"),
            "_kinds": F.size(F.array_distinct("_words")),
            "_next": F.size(F.filter(F.zip_with("_words", F.slice("_words", F.lit(2), F.size("_words")), lambda word, after: word == after), lambda same: same)),
            "_upper": _matching(F.col("_text"), r"\p{Lu}"),
            "_digits": _matching(F.col("_text"), r"\p{Nd}"),
            "_stops": _matching(F.col("_text"), r".,;:?"),
            "_shouts": _matching(F.col("_text"), r"!"),
            "_bars": _matching(F.col("_text"), r"|"),
            "_signs": _matching(F.col("_text"), r"#*$%&<>=_{}~^@"),
            "_all_lines": F.size("_lines"),
            "_line_kinds": F.size(F.array_distinct("_lines")),
        }
    )
    n, bare = F.greatest("_n", F.lit(1)), F.greatest("_bare", F.lit(1))
    values = [
        F.log1p("_chars"), F.log1p("_n"), F.col("_bare") / n, F.col("_kinds") / n, F.col("_kinds") / F.sqrt(n), F.col("_next") / n,
        F.col("_upper") / bare, F.col("_digits") / bare, F.col("_stops") / bare, F.col("_shouts") / bare, F.col("_bars") / bare,
        F.col("_signs") / bare, F.col("_all_lines") / n, F.col("_line_kinds") / F.col("_all_lines"), F.col("_bars") / n,
        F.col("_stops") / n, F.col("_upper") / n,
    ]
    # Else a filter on the score would copy all of this into itself, once for each use.
    return with_stage(rows, name, F.array(*[v.cast("double") for v in values])).select(*docs.columns, name)


@dataclass
class Forest:
    """All trees in flat arrays; node 0 of tree t is at ``roots[t]`` and a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                below = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(below, self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Grow trees on binned features with logistic loss, level by level, from histograms of gradients."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {key: [] for key in ("feature", "cut", "left", "right", "value")}
    roots: list[int] = []
    if len(y) >= 2 * LEAST and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes["value"]))
            margin += _grow(nodes, binned, cuts, y - p, p * (1 - p))
    arrays = {key: np.array(v, dtype=float if key in ("cut", "value") else np.int64) for key, v in nodes.items()}
    return Forest(roots=np.array(roots, dtype=np.int64), prior=prior, **arrays)


def _grow(nodes: dict[str, list], binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Append one tree to the flat arrays; return what it adds to each row's margin."""

    def leaf(rows: np.ndarray) -> int:
        at = len(nodes["value"])
        step = RATE * grad[rows].sum() / (hess[rows].sum() + RIDGE)
        for key, item in (("feature", 0), ("cut", 0.0), ("left", at), ("right", at), ("value", step)):
            nodes[key].append(item)
        added[rows] = step
        return at

    added = np.zeros(len(grad))
    level = [(leaf(np.arange(len(grad))), np.arange(len(grad)))]
    for _ in range(DEPTH):
        following = []
        for at, rows in level:
            best = _best_cut(binned[rows], cuts, grad[rows], hess[rows])
            if best is None:
                continue
            feature, place = best
            low = binned[rows, feature] <= place
            sides = [(leaf(own), own) for own in (rows[low], rows[~low])]
            nodes["feature"][at], nodes["cut"][at] = feature, cuts[feature][place]
            nodes["left"][at], nodes["right"][at] = sides[0][0], sides[1][0]
            following += sides
        level = following
    return added


def _best_cut(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
    total_g, total_h, best, gain = grad.sum(), hess.sum(), None, 1e-6
    for feature, own in enumerate(cuts):
        if not len(own):
            continue
        bins = len(own) + 1
        g = np.bincount(binned[:, feature], grad, bins).cumsum()[:-1]
        h = np.bincount(binned[:, feature], hess, bins).cumsum()[:-1]
        n = np.bincount(binned[:, feature], minlength=bins).cumsum()[:-1]
        gains = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
        gains[(n < LEAST) | (len(grad) - n < LEAST)] = -1
        if len(gains) and gains.max() > gain:
            best, gain = (feature, int(gains.argmax())), gains.max()
    return best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """Fit on at most ``SAMPLE_ROWS`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("_label"), F.max("quality").alias("_other"))
    known = known.where("_label = _other").select("doc_id", "_label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    taught = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most SAMPLE_ROWS rows of two numbers
    taught = with_statistics(taught).select("doc_id", "_label", "_statistics").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = taught.toPandas().sort_values(["doc_id"], kind="stable")
    if not len(rows):
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.stack(rows["_statistics"].to_list()), (rows["_label"].to_numpy() > 0).astype(float))


def with_score(docs: DataFrame, forest: Forest, name: str) -> DataFrame:
    """Add the score to every row."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_list()) if len(batch) else np.zeros((0, 1))
            yield pd.Series(held.value.score(x))

    return with_statistics(docs).withColumn(name, score("_statistics")).drop("_statistics")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier accepts, with their own columns."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    return with_score(rows, train(docs, labels), "_score").where(F.col("_score") >= ACCEPT).select("_row.*")
