"""Byte-level views of many texts at once in numpy: words and their hashes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, _U)
_inverse = np.ones(1, _U)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = -(-n // (1 << 18)) << 18
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _P)]))
            _inverse = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _P_INV)]))


def chunks(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) of about `most` bytes each."""
    own, size, first = [], 0, 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if own and size + len(raw) > most:
            yield first, own
            own, size, first = [], 0, k
        own.append(raw)
        size += len(raw) + 1
    if own:
        yield first, own


def join(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a newline after each text; and where each text begins, with the total at the end."""
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), begins


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: every bit of the result depends on every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


class Hasher:
    """Polynomial hashes of any byte ranges of one buffer from one prefix sum, modulo 2 ** 64, then mixed."""

    def __init__(self, buf: np.ndarray):
        _grow(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum((buf.astype(_U) + _U(1)) * _powers[: len(buf)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * _inverse[starts] + (ends - starts).astype(_U))

    def without(self, starts: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hashes of the ranges without their element at `at`: those of the strings that are left."""
        with np.errstate(over="ignore"):
            left, right = (self.sums[at] - self.sums[starts]) * _inverse[starts], (self.sums[ends] - self.sums[at + 1]) * _inverse[starts + 1]
            return mix(left + right + (ends - starts - 1).astype(_U))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, \\t, \\n, \\v, \\f and \\r."""
    inside = np.concatenate([[False], ~_SPACE[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]
