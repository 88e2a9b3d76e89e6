"""Dealt operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

from __future__ import annotations

import base64
import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firmledger.llm import decontaminate, licenses, near_dups, packing, quality_gbt, quality_rules, token_histogram, token_records, tool_calls, warc
from firmledger.llm.encode import Encoder, vocabulary

DATA = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, _row string, key string"
LONG = " ".join(f"w{i}x" for i in range(30_000))
AWKWARD = [
    (1, None, None, "a", "b"), (2, "", "en", None, None), (3, "one two", "xx", "c", "d"), (4, LONG, "en", "e", "f"),
    (4, LONG, "en", "e", "f"), (None, "word " * 40, "de", "g", "h"), (5, "\n\n \t", "fr", "i", "j"),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("aB é'sß.,!7\n\t  ñ<|> ́Σİ\r ")), max_size=40) | st.text(max_size=30))
def test_encoder_gives_the_librarys_ids(path, text):
    encoder = Encoder.of(path)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_warc_round_trip(spark):
    rows = [(k, f"http://a.no/{k}", f"<p>{'é' * (k % 4)}</p>") for k in range(40)] + [(50, "x\r\ny z", None), (51, None, ""), (None, "n", "<p></p>"), (7, "again", "<p>ééé</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, file string").repartition(3)
    got = warc.warc_round_trip(pages).collect()
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    expected = collections.Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        revisit = page != first[html or ""]
        mark = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[(page, len(payload), mark, "revisit" if revisit else "response", first[html or ""] if revisit else None)] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == expected


def test_warc_stream_reads_many_members_and_reports_damage(tmp_path):
    import gzip
    import io

    records = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>"}, b"x" * k) for k in range(300)]
    whole, members = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for raw in (whole, members):
        assert [len(p) for _, p in warc.RecordStream(io.BytesIO(raw), block=97)] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.RecordStream(io.BytesIO(whole[: len(whole) // 2]), block=97))


def test_warc_of_no_pages(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def base_counts(text):
    found = split(text)
    windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    many, covered = collections.Counter(windows), set()
    for k, window in enumerate(windows):
        if many[window] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if split(x)]
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, documents, awkward, empty):
    docs = documents.select("doc_id", "text", "lang").union(awkward.select("doc_id", "text", "lang"))
    texts = docs.collect()
    got = quality_rules.quality_rules(docs).collect()
    want = collections.Counter((r.doc_id, *base_counts(r.text)) for r in texts)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.keep(awkward).columns == awkward.columns


def test_quality_rules_tell_junk_from_clean_text(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in got if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def test_jensen_shannon_distance(spark):
    rows = spark.createDataFrame([([3.0, 1.0, 0.0], [1.0, 1.0, 2.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([5.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.d for r in quality_rules.with_distance(rows, "d", "a", "b").collect()]
    p, q = np.array([0.75, 0.25, 0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    kl = lambda x: sum(x[k] * np.log2(x[k] / m[k]) for k in range(3) if x[k])
    assert got == pytest.approx([np.sqrt((kl(p) + kl(q)) / 2), 0.0, 1.0])


def test_licenses(spark, awkward, empty):
    notice = licenses.TEMPLATES["mit-grant"]
    cut = " ".join(notice.split()[: int(len(notice.split()) * 0.9)])
    rows = [(10, f"Ab cd. {notice.upper()} ef"), (11, "x " * 50 + cut + " y" * 70), (12, "Released under the MIT License."), (13, "under the mit license"), (12, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.license) for r in licenses.license_notices(docs).collect()}
    assert got == {(10, "mit-grant"), (11, "mit-grant"), (12, "mit-line")}
    assert licenses.license_notices(docs).count() == 3
    assert licenses.license_notices(awkward).count() == 0 and licenses.license_notices(empty).count() == 0
    assert all((1 - j) ** licenses.bands_of(s) <= licenses.MISS for s, j in ((8, 1 / 8), (64, 0.8 * 18 / (64 + 18 - 0.8 * 18))))


def test_token_records(spark, documents, awkward, empty):
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    encoder, start, want = Encoder.of(BYTE), 0, []
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for row in rows:
        ids = np.array(encoder.tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((row.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_records.token_records(docs, BYTE).collect()), key=lambda r: r[1])
    assert got == want
    assert token_records.token_records(empty, BYTE).count() == 0


def test_record_frames_detect_damage():
    import io

    data = token_records.frame(b"abc") + token_records.frame(b"")
    stream = io.BytesIO(data)
    assert [token_records.unframe(stream) for _ in range(3)] == [b"abc", b"", None]
    for k in range(len(data) - 16):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(io.BytesIO(bytes(broken)))


def jaccard_classes(texts):
    shingles = {}
    for text in texts:
        found = split(text)
        if found:
            shingles[tuple(found)] = {tuple(found[k : k + 5]) for k in range(max(len(found) - 4, 1))}
    root = {k: k for k in shingles}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(shingles)
    index = collections.defaultdict(list)
    for number, key in enumerate(keys):
        shared = collections.Counter(other for s in shingles[key] for other in index[s])
        for other, n in shared.items():
            if n >= 0.8 * (len(shingles[key]) + len(shingles[keys[other]]) - n):
                root[find(key)] = find(keys[other])
        for s in shingles[key]:
            index[s].append(number)
    return {key: find(key) for key in keys}


def test_near_duplicates(spark, documents, awkward, empty):
    base = [f"t{k}" for k in range(200)]
    chain = [" ".join(base[:k] + [f"new{j}" for j in range(k)] + base[2 * k :]) for k in range(0, 60, 3)]
    family = [" ".join(w if (i * 7 + k * 13) % 23 else f"m{k}_{i}" for i, w in enumerate(base)) for k in range(30)]
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(chain + family + family[:3])], "doc_id bigint, text string")
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text")).union(more)
    rows = docs.collect()
    root = jaccard_classes([r.text for r in rows])
    least = {}
    for r in rows:
        if split(r.text):
            at = root[tuple(split(r.text))]
            least[at] = min(least.get(at, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    want = collections.Counter()
    for r in rows:
        null, first = least[root[tuple(split(r.text))]] if split(r.text) else (r.doc_id is None, r.doc_id)
        want[(r.doc_id, None if null else first)] += 1
    got = near_dups.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = near_dups.keep(docs.withColumn("key", F.lit("clash")))
    texts = [r.text for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "key"]
    assert len(texts) == len(set(root.values())) + sum(not split(r.text) for r in rows)
    assert near_dups.near_duplicates(empty).count() == 0


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(7)
    a, b = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
    a[40:], b[:15] = 0, 0
    hashes = rng.integers(0, 2**63, 60).astype(np.uint64)
    shingles = np.concatenate([np.repeat(hashes, a), np.repeat(hashes, b)])
    doc = np.concatenate([np.zeros(a.sum(), int), np.ones(b.sum(), int)])
    got = near_dups.signatures(shingles, doc, 2, 4096)
    p, q = a / a.sum(), b / b.sum()
    both = (p > 0) & (q > 0)
    want = sum(1 / np.maximum(p / p[k], q / q[k]).sum() for k in np.flatnonzero(both))
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.03)


def test_decontamination(spark, documents, awkward, empty):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    index = {tuple(w[k : k + 8]) for r in items.collect() for w in [re.findall(r"\w+", r.text.lower())] for k in range(len(w) - 7)}
    want = set()
    for r in documents.collect():
        w = re.findall(r"\w+", r.text.lower())
        if any(tuple(w[k : k + 8]) in index for k in range(len(w) - 7)):
            want.add(r.doc_id)
    got = decontaminate.benchmark_leaks(documents, items)
    assert {r.doc_id for r in got.where("contaminated").collect()} == want and got.count() == documents.count()
    question = "If the farmer Anna sells 12 apples for 3 euros each and then pays Anna 5 euros, how much money is left for the market?"
    asked = spark.createDataFrame([(1, question), (2, None), (3, "what is two plus two"), (1, question)], "item_id bigint, text string")
    texts = {
        1: "Well. " + question.replace("Anna", "Berta").replace("12", "40") + " So.",
        2: question.replace("Anna sells", "Berta sells"),  # Anna stands for two people, but what follows is the question word for word
        3: "He asked: what is two plus two? Four.",
        4: "a farmer sells apples at the market",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").union(awkward.select("doc_id", "text"))
    found = {r.doc_id: r.item_ids for r in decontaminate.benchmark_leaks(docs, asked).where("contaminated").collect()}
    assert found == {1: [1], 2: [1], 3: [3]}
    assert decontaminate.keep(awkward, asked).columns == awkward.columns
    assert decontaminate.benchmark_leaks(docs, asked.limit(0)).where("contaminated").count() == 0
    assert decontaminate.benchmark_leaks(empty, asked).count() == 0


def test_quality_scores(spark, awkward, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_gbt.quality_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held} == {True} and len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    for taught in (labels, labels.limit(0)):
        rows = quality_gbt.quality_scores(awkward, taught).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_gbt.quality_scores(empty, labels).count() == 0
    assert quality_gbt.keep(awkward, labels).columns == awkward.columns


def test_flat_forest_walks_like_its_training():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality_gbt.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def conversation(spark):
    calls = [
        (1, "b", 3, "ask", '{"words": 1, "text": "x"}', ["c"]), (1, "a", 1, "ask", '{ "text":"é\\n", "words":2.0}', []), (1, "c", 5, "ask", '{"text":"y","words":2}', ["a"]),
        (2, "a", 1, "ask", "{}", ["b"]), (2, "b", 2, "none", "[1]", ["a"]), (3, "a", 1, "ask", '{"text":3,"words":1,"z":null}', ["gone"]), (None, "q", 1, "ask", None, None),
        (3, "r", 2, "ask", '{"text":"p","words":4}', None), (3, "r", 2, "ask", '{"text":"p","words":4}', None),
    ]
    results = [(1, "b", 4, "B"), (1, "b", 6, "later"), (1, "a", 2, None), (9, "a", 1, "lost"), (3, "r", 7, "R")]
    return (
        spark.createDataFrame(calls, "conv_id bigint, call_id string, turn bigint, name string, arguments string, depends_on array<string>"),
        spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string"),
    )


def test_tool_calls(spark):
    calls, results = conversation(spark)
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results).collect()}
    assert len(got) == 8
    order = sorted((r for r in got.values() if r.conv_id == 1), key=lambda r: (r.level, r.turn))
    assert [r.call_id for r in order] == ["a", "c", "b"]
    assert got[2, "a"].status == got[2, "b"].status == "cyclic" and got[None, "q"].status == "unidentified"
    assert got[3, "a"].status == "invalid" and set(got[3, "a"].problems) == {"type of text", "unknown z"}
    assert got[1, "b"].n_results == 2 and got[1, "b"].result_turn == 4 and got[3, "r"].n_calls == 2
    assert json.loads(got[1, "b"].line) == {"arguments": {"text": "x", "words": 1}, "call_id": "b", "conv_id": 1, "name": "ask", "result": "B"}
    assert got[1, "b"].arguments == '{"text":"x","words":1}' and got[1, "c"].status == "unanswered"
    assert [r.call_id for r in tool_calls.orphan_results(calls, results).collect()] == ["a"]
    assert tool_calls.link_calls(calls.limit(0), results).count() == 0


def test_token_histogram(spark, documents, awkward, empty):
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    lengths = [len(Encoder.of(BYTE).tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    sums = token_histogram.token_histogram(docs, BYTE)
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.docs_over == sum(n > r.n_tokens for n in lengths)
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths) and r.tokens_total == sum(lengths)
        assert r.quantile == pytest.approx(sum(n <= r.n_tokens for n in lengths) / len(lengths))
    got = {r.limit: (r.docs_over, r.tokens_kept) for r in token_histogram.answers(sums, [0, 77, 512, 10**6]).collect()}
    assert got == {c: (sum(n > c for n in lengths), sum(min(n, c) for n in lengths)) for c in (0, 77, 512, 10**6)}
    assert token_histogram.token_histogram(empty, BYTE).count() == 0


def test_packing(spark, documents, awkward, empty):
    docs = documents.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    rows = packing.pack(docs, WORD).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*Encoder.of(WORD).tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            want[(r.doc_id, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    assert packing.pack(empty, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    slots, made = packing.plan(counts, 40)
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b + length <= 40]
            if fits:
                bins[bins.index(max(fits))] += length
            else:
                bins.append(length)
    assert made == len(bins)
    used = collections.Counter()
    for length in counts:
        own = sorted(s for s in slots if s[0] == length)
        ends = [s[1] for s in own[1:]] + [counts[length]]
        for (_, rank, first, offset), end in zip(own, ends, strict=True):
            for k in range(end - rank):
                used[first + k] += length
                assert offset + length <= 40
    assert len(used) == made and all(v <= 40 for v in used.values())
