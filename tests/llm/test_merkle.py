"""Merkle manifest against a plain tree, and its awkward cases."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from firmledger.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, pos int, chunk string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


def brute(rows, fan):
    """Rebuild whole trees: for every row the leaf, subroot, root, digest of its siblings, and the root rebuilt with the given leaf."""
    groups = collections.defaultdict(list)
    for row in map(lambda r: r.asDict(), rows):
        other = dict(row)
        if row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
            other["n_chars"] += 1
        groups[row["lang"]].append((row["doc_id"], leaf(row), leaf(other)))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {lang: levels([r[1] for r in groups[lang]], fan) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs], fan)
    out = []
    for k, lang in enumerate(langs):
        for at, (doc_id, own, given) in enumerate(groups[lang]):
            node, siblings, place = given, [], at
            for tree in (trees[lang], top):
                place = at if tree is trees[lang] else k
                for level in tree[:-1]:
                    start = place - place % fan
                    left, right = level[start:place], level[place + 1 : start + fan]
                    siblings += left + right
                    node, place = digest(*left, node, *right), place // fan
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], digest(*siblings), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, "a", ("en", "é", "zz", None, "")[k % 5], k, f"t{k}é") for k in range(57)]
    rows += [(7, "a", "en", 7, "again")] * 3 + [(None, None, None, None, None)] * 2 + [(90, None, "one", 4, ""), (91, "", "en", None, "w " * 50_000)]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize(("fan", "chunk"), [(2, 4096), (2, 2), (2, 8), (3, 9)])
def test_manifest_is_a_rebuilt_tree(spark, awkward, fan, chunk):
    got = merkle.manifest(awkward, merkle.tampered(), fan, chunk).collect()
    assert ordered(got) == ordered(brute(awkward.collect(), fan))


def test_manifest_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = merkle.merkle_manifest(docs).collect()
    assert ordered(got) == ordered(brute(docs.collect(), 2))
    hit = {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert {r.doc_id for r in got if not r.verified} == hit and hit


def test_small_manifests(spark, awkward):
    assert merkle.merkle_manifest(awkward.limit(0)).count() == 0
    (one,) = merkle.merkle_manifest(awkward.where("doc_id = 91")).collect()
    assert one.verified and one.leaf == one.subroot == one.root and one.proof_sha256 == digest() and one.folded_root == one.root
    plain = merkle.manifest(awkward, F.lit(None).cast("string"))
    assert plain.where("not verified").count() == 0


def test_fold_resumes_states_and_equals_rebuilding():
    leaves = [digest(str(k)) for k in range(11)]
    for fan in (2, 3, 4):
        tree = merkle.Subtree(leaves, fan)
        assert tree.root == levels(leaves, fan)[-1][0]
        for at in range(11):
            changed = [*leaves[:at], "0" * 64, *leaves[at + 1 :]]
            assert tree.fold(at, leaves[at]) == tree.root and tree.fold(at, "0" * 64) == levels(changed, fan)[-1][0]
