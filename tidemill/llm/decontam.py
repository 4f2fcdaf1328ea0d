"""Benchmark decontamination: which test items are contained in which documents.

A size-partitioned MinHash containment search. An item of n distinct shingles is contained if at least t = ceil(share * n)
of them occur in a document, so that at most n - t are missing: of its n - t + 1 smallest shingle hashes, its MinHash
sketch, one at least occurs too. Items are partitioned by the power of two below n, and all items of a partition take
the sketch size that its largest n needs. Documents too short for a partition skip it; those that hold a value of an
item's sketch are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import mapped, sized_join, written

WORDS, SHARE = 5, 0.8
BLOCK_SHINGLES = 2_000_000
# Words: A-Z in lower case, ASCII punctuation and white space between them.
CLEAN = bytes(i + 32 if 65 <= i <= 90 else 32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(CLEAN).split()


def shingles_of(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def _needed(n: int, share: float) -> int:
    return int(np.ceil(share * n - 1e-9))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Sketches of a block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple], words: int, share: float):
        self.share, self.items, self.parts = share, [], []
        found: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue
            width = min(words, len(w))
            h = np.unique(_rolled(_word_hashes(w), width))
            top = (2 << (len(h).bit_length() - 1)) - 1
            k = min(len(h), top - _needed(top, share) + 1)
            found.setdefault((width, len(h).bit_length() - 1), []).append((h[:k], len(self.items)))
            self.items.append((item_id, w, width))
        for (width, size), own in sorted(found.items()):
            values = np.concatenate([h for h, _ in own])
            owners = np.concatenate([np.full(len(h), i) for h, i in own])
            order = np.argsort(values, kind="stable")
            bits = max(12, int(16 * len(values)).bit_length())
            there = np.zeros(1 << bits, bool)
            there[(values >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.parts.append((width, _needed(1 << size, share), values[order], owners[order], there, np.uint64(64 - bits)))

    def search(self, text: bytes) -> list[tuple]:
        """(item_id, shingles, shared) of the items that a text contains."""
        w = words_of(text)
        base = _word_hashes(w)
        rolled: dict[int, np.ndarray] = {}
        sure: dict[int, set[bytes]] = {}
        out = []
        for width, least, values, owners, there, shift in self.parts:
            if len(w) - width + 1 < max(1, least):
                continue
            if width not in rolled:
                rolled[width] = _rolled(base, width)
            h = rolled[width]
            h = h[there[(h >> shift).astype(np.int64)]]
            if not len(h):
                continue
            h = np.unique(h)
            a, z = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
            hit = np.flatnonzero(z > a)
            for i in sorted({int(o) for j in hit for o in owners[a[j] : z[j]]}):
                if width not in sure:
                    sure[width] = shingles_of(w, width)
                item_id, own, _ = self.items[i]
                own = shingles_of(own, width)
                shared = len(own & sure[width])
                if shared >= _needed(len(own), self.share):
                    out.append((item_id, len(own), shared))
        return out


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of BLOCK_SHINGLES words at most, or of one item; a single empty one without items."""
    block, size, any_ = [], 0, False
    for item_id, text in items.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        n = len(words_of(text))
        if block and size + n > BLOCK_SHINGLES:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text or b"")))
        size, any_ = size + n, True
    if block or not any_:
        yield block


_built: dict = {}


def _index(shared: Broadcast, shared_id: str, words: int, share: float) -> Index:
    """The index of a broadcast block, built once in each Python worker, which keeps the last one."""
    if _built.get("of") != (shared_id, words, share):
        _built.update(of=(shared_id, words, share), index=Index(shared.value, words, share))
    return _built["index"]


def _block_matches(docs: DataFrame, shared: Broadcast, words: int, share: float) -> DataFrame:
    """Rows (doc_id, row, item_id, n_shingles, n_shared) of one block of items; row is a hash of the text."""
    names, own = ["doc_id", "row", "item_id", "n_shingles", "n_shared"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, own, words, share)
        for b in batches:
            rows = [(k, r, *x) for k, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("t")) if t.is_valid for x in index.search(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    texts = docs.select("doc_id", F.xxhash64(F.lit(5), "text").alias("row"), F.col("text").cast("binary").alias("t"))
    return mapped(texts, run, ", ".join(f"{n} long" for n in names))


def _matches(docs: DataFrame, items: DataFrame, words: int, share: float) -> DataFrame:
    """The matches of all blocks. A single block is searched as the result is read; of several, each is searched and
    its matches are written before the next is sent out, so that one block is alive at a time."""
    sc = docs.sparkSession.sparkContext
    blocks = item_blocks(items)
    first = sc.broadcast(next(blocks))
    out = _block_matches(docs, first, words, share)
    second = next(blocks, None)
    if second is None:
        return out
    parts = [written(out)]
    first.destroy()
    for block in chain([second], blocks):
        shared = sc.broadcast(block)
        parts.append(written(_block_matches(docs, shared, words, share)))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def contained_items(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_shared, containment): the items of which a document holds ``share`` or more.

    Items are read in blocks of BLOCK_SHINGLES words at most (or one item), each of which meets all documents, whole
    texts, in a pass of its own; one block at a time is broadcast. Items with fewer words are one shingle of all their
    words; those that are null or without words are in no document. Null texts hold none. Rows of one doc_id or item_id
    are searched row by row, and a null id of either stays null. Other columns aren't read.
    """
    found = _matches(docs, items, words, share).drop("row")
    return found.withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def keep_clean(docs: DataFrame, items: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """The rows of documents that contain no item, all columns as they are.

    Null and empty texts contain none and stay, as do all without items; repeated rows stay or go together. Bytes that
    are no UTF-8 are read as they are. One block of items is a filter; with more, rows that any block finds are looked
    up by id and a hash of the text.
    """
    blocks = item_blocks(items)
    block = next(blocks)
    if next(blocks, None) is not None:
        id_ = F.coalesce("doc_id", F.lit(-(2**63)))
        bad = written(_matches(docs, items, words, share).select(id_.alias("_id"), F.col("row").alias("_row")).distinct())
        rows = docs.select(F.struct("*").alias("_own"), id_.alias("_id"), F.xxhash64(F.lit(5), "text").alias("_row"))
        return sized_join(rows, bad, ["_id", "_row"], F.monotonically_increasing_id(), "left_anti").select("_own.*")
    shared, at, own = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared, own, words, share)
        for b in batches:
            yield b.filter(pa.array([not index.search(t.as_py() or b"") for t in b.column(at).cast(pa.binary())], pa.bool_()))

    return mapped(docs, run, docs.schema)


ORACLE = f"""
WITH w AS (
    SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS n, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
t AS (SELECT kind, id, n, list_filter(string_split_regex(translate(regexp_replace(text, '[^\\x{{80}}-\\x{{10FFFF}}0-9A-Za-z]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' +'), lambda y: y <> '') AS x FROM w),
i AS (SELECT id AS item_id, n AS item, least({WORDS}, len(x)) AS k, list_distinct(list_transform(range(1, len(x) - least({WORDS}, len(x)) + 2), lambda a: array_to_string(x[a:a + least({WORDS}, len(x)) - 1], ' '))) AS s FROM t WHERE kind = 1 AND len(x) > 0),
e AS (SELECT item_id, item, k, len(s) AS n_shingles, unnest(s) AS shingle FROM i),
d AS (SELECT t.id AS doc_id, t.n AS doc, z.k, unnest(list_distinct(list_transform(range(1, len(x) - z.k + 2), lambda a: array_to_string(x[a:a + z.k - 1], ' ')))) AS shingle FROM t, (SELECT DISTINCT k FROM i) z WHERE kind = 0)
SELECT doc_id, item_id, CAST(any_value(n_shingles) AS BIGINT) AS n_shingles, count(*) AS n_shared, round(count(*) / any_value(n_shingles), 6) AS containment
FROM d JOIN e ON e.k = d.k AND e.shingle = d.shingle GROUP BY doc_id, doc, item_id, item HAVING count(*) >= ceil({SHARE} * any_value(n_shingles) - 1e-9)
"""
