"""Token ids through the tokenizers library, with a bounded memo of the pieces between white space.

Both vocabularies end a token wherever white space follows something else, so a text may be cut there and its pieces encoded
one by one: the ids are those of the whole text. Plain words with trailing signs go to the library's model directly; any
other piece, and any text whose white space is not single spaces and line breaks or that holds an added token of the vocabulary
(``<|endoftext|>``), goes through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces the memo of one Python worker holds; at this number it starts anew. Bounds memory, never changes ids.
MEMO_PIECES = 800_000
#: Bytes of text that ``Encoder.each`` takes apart at once.
SLICE_BYTES = 1 << 23

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_NAMED_PLAIN = "^" + _PLAIN.pattern.replace("(", "(?P<word>", 1).replace("+)(", "+)(?P<signs>", 1) + "$"
_ODD_SPACE = re.compile("  |[\n] |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]| $")


def _byte_letters() -> dict[int, int]:
    """Code points that stand for bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SPACE = chr(_LETTERS[0x20])


class _Memo(dict):
    """Ids of words or runs of signs, looked up or made by the model."""

    def __init__(self, model) -> None:
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        shown = piece.replace(" ", _SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS)
        ids = array("I", [token.id for token in self.model.tokenize(shown)]).tobytes()
        if len(self) >= MEMO_PIECES:
            self.clear()
        self[piece] = ids
        return ids


class _Pieces(dict):
    """Ids of pieces that are not words in the memo: taken apart at line breaks and signs, or left to the library."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        encoder, found = self.encoder, _PLAIN.fullmatch(piece)
        if found:
            word, signs = found.groups()
            ids = encoder.words[self.lead + (word.lower() if encoder.drops_space else word)]
            if signs:
                return ids + encoder.words[signs]
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
            return ids
        first, line, rest = piece.partition("\n")
        if line and first and rest and rest[0] != "\n":
            return self[first] + encoder.line + encoder.at_start[rest]
        return encoder.whole(self.lead + piece)


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Some vocabularies look for added tokens in the lower-cased text.
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        # A vocabulary with a word-end suffix drops white space and case; the other keeps a space before a word.
        self.drops_space = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.words = _Memo(self.tokenizer.model)
        self.after_space, self.at_start = _Pieces(self, " "), _Pieces(self, "")
        self.line = self.whole("\n")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each vocabulary and Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added.search(text):
            return self.whole(text)
        if self.drops_space:
            return b"".join(map(self.at_start.__getitem__, text.replace("\n", " ").split(" ")))
        if _ODD_SPACE.search(text):
            return self.whole(text)
        pieces = text.split(" ")
        return self.at_start[pieces[0]] + b"".join(map(self.after_space.__getitem__, pieces[1:]))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of an Arrow column in order, as ``encode`` gives them; a null is an empty text.

        Works on slices of bounded size (a longer text is a slice of its own): the distinct pieces of a slice are looked up once
        and the ids of the texts are gathered from the table of pieces.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(texts):
            limit = (ends[start - 1] if start else 0) + SLICE_BYTES
            stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
            yield from self._slice(texts.slice(start, stop - start))
            start = stop

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.drops_space:
            yield from (np.frombuffer(self.encode(text), "<u4") for text in texts.to_pylist())
            return
        whole = pc.match_substring_regex(texts, _ODD_SPACE.pattern)
        if self.added.pattern != "(?!)":
            whole = pc.or_(whole, pc.match_substring_regex(texts, self.added.pattern, ignore_case=True))
        lists = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        bounds = lists.offsets.to_numpy()
        pieces = lists.flatten()
        firsts = pieces.take(pa.array(bounds[:-1])).to_pylist()
        coded = pieces.dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        codes[bounds[:-1]] = len(distinct) + np.arange(len(firsts))
        plain = pc.extract_regex(distinct, _NAMED_PLAIN)
        spaced = pc.binary_join_element_wise(" ", pc.struct_field(plain, "word"), "")
        rest = iter(distinct.filter(pc.is_null(spaced)).to_pylist())
        word, other = self.words, self.after_space
        found = [
            (word[key] + word[signs] if signs else word[key]) if key else other[next(rest)]
            for key, signs in zip(spaced.to_pylist(), pc.struct_field(plain, "signs").to_pylist(), strict=True)
        ]
        found += map(self.at_start.__getitem__, firsts)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        many = sizes[codes]
        ends = np.cumsum(many)
        ids = ids[np.repeat(starts[codes] - ends + many, many) + np.arange(int(many.sum()))]
        bounds, row = np.append(0, ends)[bounds], 0
        for alone, text in zip(whole.to_pylist(), texts, strict=True):
            if alone:
                yield np.frombuffer(self.whole(text.as_py()), "<u4")
            else:
                yield ids[bounds[row] : bounds[row + 1]]
                row += 1


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
