"""Hashed byte n-grams and words of texts, as numpy arrays, a piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_powers = np.zeros(0, np.uint64)
_inverses = np.zeros(0, np.uint64)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at + 1, end)
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def ngrams(a: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes (bits wide) of all runs of n <= 7 bytes; n itself is part of what is hashed."""
    if len(a) < n:
        return np.zeros(0, np.int64)
    code = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        code <<= np.uint64(8)
        code |= a[i : len(a) - n + 1 + i]
    code *= _MULT
    code >>= np.uint64(64 - bits)
    return code.view(np.int64)


def _tables(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_powers", _BASE), ("_inverses", inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x)


def words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, and their lengths: differences of a rolling sum."""
    _tables(len(a) + 1)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers[: len(a)])])
    h = (sums[ends] - sums[starts]) * _inverses[starts]
    h ^= h >> np.uint64(29)
    return h * _MULT, ends - starts
