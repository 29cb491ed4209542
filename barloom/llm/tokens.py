"""Token ids of whole texts with the tokenizers library, fast where words recur.

A text is cut at its single spaces. No pre-token of the two byte-pair vocabularies reaches from one such
piece into the next, so a piece's ids don't depend on its neighbours and a bounded memo of pieces stands
for the library. A new piece of plain Latin text is cut by the vocabulary's own pre-token pattern and its
pre-tokens go to the library's model; any other piece goes through the library whole. So does a text that
may hold the string of one of the vocabulary's special tokens, which the library takes for the token.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from string import punctuation

import numpy as np

from .common import claim

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[ \n!-~{LATIN}]*")
#: Letters, and the pre-token patterns of the two public vocabularies, for plain Latin text.
_LETTERS = re.compile(rf"[{LATIN}]+").fullmatch
_BYTE_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
_WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")
#: A memo's generation holds twice MEMO pieces, or LOWERED where words are lowered; two full ones of 500,000 take some 160 MB of a worker.
MEMO, LOWERED = 250_000, 250_000


class _Pieces(dict):
    """Piece to its ids as little-endian 16-bit words; two generations of at most `most` pieces each."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextEncoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids; null texts have no ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.cut = self.tok.model.tokenize  # each look at .model wraps it anew
        named = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.named = re.compile("|".join(map(re.escape, named)) if named else r"(?!)", re.IGNORECASE)
        self.mark = os.path.commonprefix(named)
        if self.tok.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        self.lower = self.tok.normalizer is not None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelt = {b: c for x in map(chr, range(256)) for b, c in zip(x.encode(), level.pre_tokenize_str(x)[0][0])}
        self.bytes_as = "".join(spelt.get(b, "\ufffe") for b in range(256))  # what charmap_decode takes for undefined
        self.space = self.bytes_as[32]
        self.raw = [array("H", [k]).tobytes() for k in range(self.tok.get_vocab_size())]
        self.pieces = _Pieces(self._lowered, LOWERED) if self.lower else _Pieces(self._spaced, 2 * MEMO)
        self.parts = _Pieces(self._model, MEMO // 5)

    def _model(self, part: str) -> bytes:
        spelt, _ = charmap_decode(part.encode(), "strict", self.bytes_as)
        return b"".join([self.raw[t.id] for t in self.cut(spelt)])

    def _whole(self, piece: str) -> bytes:
        return array("H", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def _spaced(self, word: str) -> bytes:
        """Of a piece that follows a space, the space included; words inside longer pieces share the memo."""
        if _LETTERS(word):
            if word.isascii():  # its bytes stand for themselves
                return b"".join([self.raw[t.id] for t in self.cut(self.space + word)])
            return self._model(" " + word)
        stem = word.rstrip(punctuation)
        if stem != word and _LETTERS(stem):  # a word and the marks after it are two pre-tokens
            return self.pieces[stem] + self.parts[word[len(stem) :]]
        if not _PLAIN.fullmatch(word):
            return self._whole(" " + word)
        first, *rest = _BYTE_CUT.findall(" " + word)
        ids = self.pieces[first[1:]] if _LETTERS(first[1:]) else self.parts[first]
        return ids + b"".join(map(self.parts.__getitem__, rest))

    def _lowered(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        low = piece.lower()
        if _LETTERS(low):
            return self._model(low) if low == piece else self.pieces[low]
        return b"".join(self.pieces[p] if _LETTERS(p) else self.parts[p] for p in _WORD_CUT.findall(low))

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        if self.mark in text and self.named.search(text):
            return np.frombuffer(self._whole(text), "<u2")
        if self.lower:
            return np.frombuffer(b"".join(map(self.pieces.__getitem__, text.split(" "))), "<u2")
        if "  " in text:  # a run of spaces is cut by what stands around it
            return np.frombuffer(self._whole(text), "<u2")
        first, *rest = text.split(" ")
        head = self.parts[first] if _LETTERS(first) else self._whole(first)
        return np.frombuffer(head + b"".join(map(self.pieces.__getitem__, rest)), "<u2")


_made: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each vocabulary and worker process: its memo outlives a task, until another operator claims the worker."""
    claim("tokens", _made.clear)
    if path not in _made:
        _made[path] = TextEncoder(path)
    return _made[path]
