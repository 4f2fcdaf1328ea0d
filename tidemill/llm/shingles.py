"""Hashes of the word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK = 65536


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of the shingles of a text, repeats included, CHUNK at a time."""
    import xxhash

    w = text.translate(LOWER).split()
    if not w:
        return
    joined = b" ".join(w)
    if len(w) < words:
        yield np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = ends - sizes, ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        n = min(CHUNK, len(ends) - at)
        yield np.fromiter((digest(joined[a:z], 42) for a, z in pairs), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: a bit is 1 if over half of them have it."""
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])
