"""Ids of texts that hold added tokens, against a freshly loaded library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from firmledger.llm import encode, packing, token_histogram, token_records
from firmledger.llm.encode import Encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
MARKED = ["see <|endoftext|> here", "a<|startoftext|>b", "A <|ENDOFTEXT|>\nb", "<|endof text|> x", "x  <|endoftext|><|endoftext|> ", "plain words, only"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_have_the_ids_of_a_fresh_library(path):
    fresh = Tokenizer.from_file(path)
    for text in MARKED:
        assert np.frombuffer(Encoder.of(path).encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, text


def test_records_histogram_and_packing_count_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id bigint, text string")
    fresh, start, want = Tokenizer.from_file(BYTE), 0, []
    for number, text in enumerate(MARKED):
        ids = np.array(fresh.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((number, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_records.token_records(docs, BYTE).collect()) == want
    lengths = [n - 1 for _, _, n, _ in want]
    assert {r.n_tokens: r.n_docs for r in token_histogram.token_histogram(docs, BYTE).collect() if r.n_docs} == {n: lengths.count(n) for n in lengths}
    words = Tokenizer.from_file(WORD)
    pieces = {r[0]: (r[3], r[4]) for r in packing.pack(docs, WORD).collect()}
    for number, text in enumerate(MARKED):
        ids = np.array([*words.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert pieces[number] == (len(ids), zlib.crc32(ids.tobytes()))


def test_slices_equal_the_library():
    rng, pieces = random.Random(5), ["the", "The,", "|", "a.\nb", "é", "日本", "don't", "x  y", "\t", "<|endoftext|>", "12.5", "...", "\n\n", "", "und", "END!!"]
    texts = [None, "", " ", "\n", "end ", "x \n", "a" * 5000, *(" ".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(400))]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = encode.Encoder(encode.vocabulary(name))
        for slice_bytes in (1, 300, 1 << 23):
            encode.SLICE_BYTES, before = slice_bytes, encode.SLICE_BYTES
            try:
                got = [ids.tobytes() for ids in encoder.each(pa.array(texts, pa.string()))]
            finally:
                encode.SLICE_BYTES = before
            assert got == [encoder.whole(text or "") for text in texts]
    assert list(encoder.each(pa.array([], pa.string()))) == []
