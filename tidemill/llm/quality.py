"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its hashed words, word pairs, repeats and byte n-grams; a softmax over it
gives the label. Vectors and output are learned by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import ngrams, pieces, words
from .langid import held_out, within_bytes
from .work import mapped, written

BITS, SIZE, ORDERS, BACK = 16, 8, (2, 3, 4), 4
EPOCHS, RATE = 12, 0.3
#: Bounds of the labelled rows to learn from.
SAMPLE, MOST_BYTES = 3000, 64 << 20
FOLDS, HELD_FOLD, THRESHOLD = 4, 2, 0.7


def hashed(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the features of a whole text, some at a time.

    Words; words behind the one before, where a word that repeats one of the BACK before it is only named a repeat; the
    byte n-grams of ORDERS, white space included; and the text's end, which tells short texts.
    """
    shift = np.uint64(64 - BITS)
    for p in pieces(text):
        a = np.frombuffer(p, np.uint8)
        h, _ = words(a)
        if len(h):
            yield (h >> shift).astype(np.int64)
            pair = h[1:] * np.uint64(3) + h[:-1]
            yield ((pair * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            for back in range(1, BACK + 1):
                n = int((h[back:] == h[:-back]).sum())
                yield np.full(n, (back * 2654435761 & 0xFFFFFFFF) >> (32 - BITS), np.int64)
        for n in ORDERS:
            yield ngrams(a, n, BITS)
    yield np.full(4, 1, np.int64)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a whole text; shares sum to 1."""
    counts = np.zeros(1 << BITS, np.int64)
    for h in hashed(text):
        counts += np.bincount(h, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / counts.sum()).astype(np.float32)


def learn(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, output, bias): softmax(share @ vectors[buckets] @ output + bias) are the probabilities of both labels."""
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE)).astype(np.float32)
    output, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    n = max(1, len(labels))
    steps, done = max(1, epochs * n), 0
    for _ in range(epochs if len(set(labels)) > 1 else 0):
        for i in rng.permutation(n):
            at, share = bags[i]
            own = vectors[at]
            hidden = share @ own
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = output @ p
            output -= step * np.outer(hidden, p)
            bias -= step * np.float32(0.1) * p
            # shares are small: the vectors' steps are scaled up by the number of buckets
            vectors[at] = own - step * np.outer(share * np.float32(len(at) ** 0.5), back)
            done += 1
    if len(set(labels)) == 1:
        bias[labels[0]] = 2.0
    return vectors, output, bias


class Model:
    """score(text): the probability of label 1."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE):
        vectors, output, bias = learn(bags, labels, epochs, rate)
        # As the output is linear in the average, one number for each bucket gives the score.
        self.log_odds = (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64)
        self.bias = float(bias[1] - bias[0])

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for h in hashed(text):
            total += float(self.log_odds[h].sum())
            n += len(h)
        return round(float(1 / (1 + np.exp(-(total / n + self.bias)))), 6)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, quality, at, share) of about ``sample`` labelled documents outside the held-out fold at most, picked by hash.

    A document with several labels counts with the largest; null labels don't count.
    """
    own = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = own.count()
    u = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    own = own.filter(u < min(1.0, sample / max(1, n)))
    x = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(own, "doc_id").select("doc_id", "quality", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 200):
                found = [bag(t.as_py() or b"") for t in b.column("t")[at : at + 200]]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id")[at : at + 200], b.column("quality")[at : at + 200], pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float16).tobytes() for f in found], pa.binary())],
                    names=["doc_id", "quality", "at", "share"],
                )

    return mapped(x, run, "doc_id long, quality int, at binary, share binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on a sample of whole labelled texts, bounded by ``sample`` documents and most_bytes of their bags, or one of each label."""
    found = written(training_rows(docs, labels, sample))
    u = F.xxhash64(F.lit(29), "doc_id")
    sizes = found.select("quality", u, F.octet_length("at") + F.octet_length("share")).collect()
    taken = within_bytes([tuple(r) for r in sizes], most_bytes)
    if not taken:
        return Model([], [])
    upto = docs.sparkSession.createDataFrame(list(taken.items()), "quality int, upto long")
    some = found.join(F.broadcast(upto), "quality").filter(u <= F.col("upto")).select("doc_id", "quality", "at", "share")
    rows = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in some.toLocalIterator()), key=lambda r: r[0])
    bags = [(np.frombuffer(a, np.uint16), np.frombuffer(s, np.float16).astype(np.float32)) for _, _, a, s in rows]
    return Model(bags, [int(r[1]) for r in rows])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, held: Column | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of documents, from the whole text alone.

    Null and empty texts are scored by the text's end alone. Rows without a doc_id are held out. Other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = held_out(F.col("doc_id"), FOLDS, HELD_FOLD) if held is None else held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.array([m.score(t.as_py() or b"") for t in b.column("t")], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("t")), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents whose text scores ``threshold`` or more, all columns as they are.

    Null and empty texts are scored by the text's end alone; bytes that are no UTF-8 are read as they are. Repeated rows
    stay or go together, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py() or b"") >= threshold for t in b.column(at).cast(pa.binary())], pa.bool_()))

    return mapped(docs, run, docs.schema)
