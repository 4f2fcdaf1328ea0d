"""SimHash near-dedup with covering locality-sensitive hashing.

Bit i of a fingerprint has a vector m(i) of radius + 1 bits, and each nonzero vector v of radius + 1 bits a table whose
mask holds the bits i with an odd m(i) & v. Some v is orthogonal to the vectors of any ``radius`` bits, so a pair that
differs in no more bits than that agrees on the whole mask of some table (Pagh, 2016).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import bit_counts, majority, shingle_hashes
from .stars import components
from .work import checkpointed, mapped, skew_join, width, written

RADIUS = 4
HOT_GROUP = 32768


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        ones += bit_counts(h)
        n += len(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """Rows (doc_id, fp) of all whole texts, fp as a signed 64-bit integer. A null text has none of the words, so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(x.as_py() or b"", words) for x in b.column("t")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select("doc_id", F.col("text").cast("binary").alias("t")), run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """The masks of 2^(radius + 1) - 1 tables over the given bit positions, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << bit for rank, bit in enumerate(bits) if ((1 + rank % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a group: rows whose fp differ in radius bits at most.

    Only rows without a component yet are compared, so tight groups take about as many comparisons as they have rows.
    """
    left, right = [], []
    todo = np.arange(len(fp))
    while len(todo) > 1:
        root, todo = todo[0], todo[1:]
        front = [root]
        while front and len(todo):
            near = np.bitwise_count(fp[todo] ^ fp[front.pop()]) <= radius
            hit = todo[near]
            if len(hit):
                todo = todo[~near]
                left += [root] * len(hit)
                right += hit.tolist()
                front += hit.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def _links_in_groups(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) between fingerprints that share all keys; rows hold the keys and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def links() -> pa.RecordBatch:
            k, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            cut = np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            two = starts[ends - starts == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            left, right = [two[near]], [two[near] + 1]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
                a, b = spanning_links(fp[s:e], radius)
                left.append(a + s)
                right.append(b + s)
            return pa.RecordBatch.from_arrays([pa.array(fp[np.concatenate(i).astype(np.int64)].view(np.int64)) for i in (left, right)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            same = np.all(k == k[-1], axis=1)
            last = len(k) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:  # the last group may go on in the next batch
                held.append((k[:last], fp[:last]))
                yield links()
                held = []
            elif held and np.any(held[-1][0][-1] != k[0]):
                yield links()
                held = []
            held.append((k[last:], fp[last:]))
        if held:
            yield links()

    dealt = rows.select(*keys, "fp").repartition(width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "fp")
    return mapped(dealt, run, "a long, b long")


def covering_links(nodes: DataFrame, radius: int = RADIUS, hot_group: int = HOT_GROUP) -> DataFrame:
    """Links (a, b) that span the components of different fingerprints (column fp).

    No group is compared pair by pair where it holds more than hot_group rows: those rows go to tables over the bits
    outside the first mask, where a pair within the radius still collides. A count of the rows by hashed table and key,
    with as many bins as keep bins of ordinary groups below hot_group, tells where such groups can be.
    """
    masks = covering_masks(list(range(64)), radius)
    made = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)))
    rows = nodes.select("fp", F.explode(made).alias("x")).select("fp", "x.t", "x.k")
    bins = max(4096, len(masks) * nodes.count() // max(1, hot_group // 8))
    binned = rows.withColumn("bin", F.pmod(F.xxhash64("t", "k"), F.lit(bins)))
    full = checkpointed(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_group).select("bin"))
    if full.isEmpty():
        return _links_in_groups(rows, ["t", "k"], radius)
    hot = checkpointed(binned.join(full, "bin", "left_semi").groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_group).select("t", "k"))
    out = _links_in_groups(rows.join(hot, ["t", "k"], "left_anti"), ["t", "k"], radius)
    again = rows.join(hot, ["t", "k"], "left_semi")
    inner = F.array(*(F.array(*(F.lit(_signed(mask | m)) for m in covering_masks([i for i in range(64) if not mask >> i & 1], radius))) for mask in masks))
    deeper = again.select("fp", "t", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("u", "m")).select("fp", "t", "u", F.col("fp").bitwiseAND(F.col("m")).alias("k2"))
    return out.unionByName(_links_in_groups(deeper, ["t", "u", "k2"], radius))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, hot_group: int = HOT_GROUP) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of documents.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest doc_id of
    the component. Equal fingerprints are one node, counted before the shuffle; one that many documents have is joined
    without a shuffle of them. Null, empty and blank texts have fingerprint zero and are linked like any other. A row
    with a null doc_id is linked too, but names no component: it gets the smallest doc_id of its component, or null if
    there is none. Other columns aren't read.
    """
    prints = written(fingerprints(docs, words))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(covering_links(nodes, radius, hot_group))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    of = written(skew_join(named, least, ["root"], "fps", nodes.count()).select("fp", "n", "component_id"))
    return skew_join(prints, of, ["fp"], "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
