"""The pipeline's stages on small tables, and every query of the subpackage on the smallest scale."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest

from firmledger.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_rows_of_their_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.schema == docs.schema, name
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) and 0 < len(ids) <= len(seen), name
        docs = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r.doc_id for r in docs.collect()}
    assert sum(labels.get(i) == 0 for i in left) <= 3
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    index = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    for i in left:
        w = re.findall(r"\w+", seen[i].lower())
        assert not any(tuple(w[k : k + 8]) in index for k in range(len(w) - 7))


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r.offset + r.length <= 4096 for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs(spark, name):
    assert queries()[name](spark, DATA).count() > 0
