"""Near duplicates that repeat a passage differently."""

from __future__ import annotations

import collections
import itertools
import random

from firmledger.llm import near_dups


def test_texts_that_repeat_a_passage_differently_are_near_duplicates(spark):
    rows = []
    for k in range(12):
        words, passage = [f"d{k}w{i}" for i in range(200)], [f"d{k}p{i}" for i in range(20)]
        rows += [(2 * k, " ".join(words + passage)), (2 * k + 1, " ".join(words + passage * 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    assert got == {k: k - k % 2 for k in range(24)}


def test_copies_on_both_sides_of_the_limit_need_few_pairs(spark, monkeypatch):
    draw, base = random.Random(5), [f"b{i}" for i in range(150)]
    texts = []
    for k in range(320):
        words = list(base)
        for at in draw.sample(range(150), draw.randrange(1, 12)):
            words[at] = draw.choice(("", "same", f"n{k}x{at}"))
        texts.append(" ".join(w for w in words if w))
    # Copies of a far copy, linked to it but not to the base.
    far = [w if i % 9 else f"far{i}" for i, w in enumerate(base)]
    texts += [" ".join(far[:at] + ["own"] + far[at + 1 :]) for at in range(3, 150, 10)]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in enumerate(t.split() for t in texts)}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    want = {k: top(k) for k in sets}
    assert 50 < len(set(want.values())) < 250 and collections.Counter(want.values()).most_common(2)[1][1] > 10

    held, plain = [], near_dups.verified

    def counted(pairs, *more):
        held.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(near_dups, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()} == want
    assert held[-1] < len(texts) and sum(held) < 20 * len(texts), held
