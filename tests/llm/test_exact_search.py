"""Exact top-k search against plain sorting, and its awkward cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from firmledger.llm import exact_search

SCHEMA = "vec_id bigint, embedding array<float>, dim string, rows int, rank int"


def brute(rows, k, divisor=50, scale=256):
    usable = [(n, r[0], [math.floor(scale * x) for x in r[1]]) for n, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for n, query, q in usable:
        if query is None or query % divisor:
            continue
        scores = [(sum(a * b for a, b in zip(q, c, strict=True)), other) for m, other, c in usable if m != n and len(c) == len(q)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(query, rank, other, score) for rank, (score, other) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


ROWS = [
    (1, [1.0, 2.0]), (0, [0.5, 0.5]), (0, [0.5, 0.5]), (50, [3e4, 1e6]), (None, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
    (6, [float("inf"), 1.0]), (100, [1.0]), (150, []), (200, []), (7, []), (-50, [-1.0, -0.001]), *[(1000 + i, [0.25, 0.25]) for i in range(40)],
]


@pytest.mark.parametrize("sizes", [(1024, 4096, 8, 16, 9), (1, 2, 2, 2, 1), (3, 5, 1, 2, 4)])
def test_awkward_vectors(spark, monkeypatch, sizes):
    for name, value in zip(("QUERY_ROWS", "CANDIDATE_ROWS", "BLOCKS", "FAN_IN", "BIN_BITS"), sizes, strict=True):
        monkeypatch.setattr(exact_search, name, value)
    vectors = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in exact_search.nearest(vectors).collect()), key=str) == brute(ROWS, 5)


def test_all_vectors_of_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = exact_search.top_k(vectors, F.col("vec_id") % 20 == 0, 7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 7, 20)


def test_limits(spark):
    assert exact_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    far = spark.createDataFrame([(0, [2.0**30] * 4), (1, [2.0**30] * 4)], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="64 bits"):
        exact_search.nearest(far)
    # Beyond what doubles hold: whole numbers, exact.
    near = [(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 1.00390625])]
    vectors = spark.createDataFrame(near, "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in exact_search.nearest(vectors).orderBy("rank").collect()] == brute(near, 5)
