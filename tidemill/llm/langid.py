"""Language ID: a family first, each against the others, then one-versus-one linear support vector machines between its languages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import ngrams, pieces
from .work import mapped, written

UNDETERMINED = "und"
ORDERS, BITS = (1, 2, 3), 14
#: Bounds of the labelled rows to learn from.
PER_LANG, MOST_ROWS, MOST_BYTES = 300, 9600, 64 << 20
FOLDS, HELD_FOLD = 5, 0
# Families of languages by ISO 639-1 code. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "bantu": "rw sn sw xh zu",
}
LETTER = re.compile(r"[^\W\d_]")
BLANK = bytes(i if chr(i).isalpha() or i > 127 else 32 for i in range(256))


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


def _counts(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of the letters of a whole text in lower case, one space between and around words."""
    letters = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(BLANK).split()) + b" "
    out = np.zeros(1 << BITS, np.int64)
    for p in pieces(letters):
        a = np.frombuffer(p, np.uint8)
        out += np.bincount(np.concatenate([ngrams(a, n, BITS) for n in ORDERS]), minlength=1 << BITS)
    return out


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a whole text: roots of counts, which makes the vector of length 1."""
    counts = _counts(text)
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at] / counts.sum())


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_FOLD) -> Column:
    """True for rows never learned from: those of the fold, by crc32 of the key as text, and those without a key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def _with_bias(x: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.append(at, 1 << BITS).astype(np.int32), np.append(values, 1).astype(np.float32)) for at, values in x]


def costs(y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """What a row's loss weighs: both classes weigh the same together."""
    return np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * penalty * 10


def train_svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, penalty: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent.

    x has (buckets, values) with the bias as a last value of 1, y is 1 or -1. It minimizes |w|^2 / 2 + sum of each row's
    cost times max(0, 1 - y w x).
    """
    square = [float(values @ values) for _, values in x]
    most = costs(y, penalty).tolist()
    y = y.tolist()
    alpha, w = [0.0] * len(y), np.zeros((1 << BITS) + 1, np.float32)
    order = np.random.default_rng(5)
    for _ in range(rounds):
        step = 0.0
        for i in order.permutation(len(y)):
            at, values = x[i]
            gradient = y[i] * float(values @ w[at]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = max(step, abs(new - alpha[i]))
                w[at] += np.float32((new - alpha[i]) * y[i]) * values
                alpha[i] = new
        if step < 1e-4:
            break
    return w


def _logistic(margin: float) -> float:
    return float(1 / (1 + np.exp(-3 * margin)))


class Model:
    """A machine for each family against the others, and within each family one for each pair of its languages.

    The family of the greatest margin is taken; its languages' machines vote, and the sums of their logistic margins
    settle ties. With two families, one machine tells them apart.
    """

    def __init__(self, x: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        x = _with_bias(x)
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(self.families)
        of, family = np.array(langs), np.array([family_of(v) for v in langs])
        weights = []
        for f in self.names[: 1 if len(self.names) == 2 else None] if len(self.names) > 1 else []:
            weights.append(train_svm(x, np.where(family == f, 1.0, -1.0)))
        self.pairs: dict[str, list[tuple[int, str, str]]] = {}
        for f in self.names:
            for a, b in combinations(self.families[f], 2):
                rows = np.flatnonzero((of == a) | (of == b))
                self.pairs.setdefault(f, []).append((len(weights), a, b))
                weights.append(train_svm([x[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0)))
        self.weights = np.ascontiguousarray(np.array(weights, np.float32).T) if weights else np.zeros(((1 << BITS) + 1, 0), np.float32)

    def _family(self, margins: np.ndarray) -> tuple[str, float]:
        if len(self.names) < 3:
            best = 0 if len(self.names) == 1 or margins[0] > 0 else 1
            return self.names[best], _logistic(abs(margins[0])) if len(self.names) == 2 else 1.0
        best = int(np.argmax(margins[: len(self.names)]))
        return self.names[best], _logistic(margins[best])

    def _language(self, family: str, margins: np.ndarray) -> tuple[str, float]:
        choices = self.families[family]
        if len(choices) == 1:
            return choices[0], 1.0
        share: dict[str, list[float]] = {c: [] for c in choices}
        for i, a, b in self.pairs[family]:
            p = _logistic(margins[i])
            share[a].append(p)
            share[b].append(1 - p)
        votes = {c: (sum(p > 0.5 for p in v), sum(v) / len(v)) for c, v in share.items()}
        best = max(choices, key=lambda c: votes[c])
        return best, votes[best][1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not LETTER.search(text):
            return UNDETERMINED, 0.0
        at, values = profile(text)
        margins = values @ self.weights[at] + self.weights[-1]
        family, p = self._family(margins)
        lang, q = self._language(family, margins)
        return lang, round(min(1.0, max(0.0, p * q)), 6)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows (lang, u, at, x) of at most about per_lang documents of every language, picked by hash of the document id, and at least one.

    Where that would be more than most_rows in all, every language gets an equal share of them.
    """
    x = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    x = x.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    counts = [(r[0], r[1], r[2]) for r in x.groupBy("lang").agg(F.count(F.lit(1)), F.min("u")).collect()]
    if not counts:
        return x.limit(0).select("lang", "u", F.lit(b"").alias("at"), F.lit(b"").alias("x"))
    most = min(per_lang, most_rows / len(counts))
    limits = docs.sparkSession.createDataFrame([(lang, max(least + 1, int(np.ceil(min(1.0, most / n) * (1 << 30))))) for lang, n, least in counts], "lang string, below long")
    some = x.join(F.broadcast(limits), "lang").filter("u < below").select("lang", "u", F.col("text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profile(t.as_py().decode("utf-8", "replace")) for t in b.column("t")]
            at, values = ([v[i].astype(kind).tobytes() for v in found] for i, kind in enumerate((np.int32, np.float16)))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("u"), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["lang", "u", "at", "x"])

    return mapped(some, run, "lang string, u long, at binary, x binary")


def within_bytes(sizes: list[tuple], most: int) -> dict:
    """For each group the greatest u of the rows to take, from rows (group, u, bytes).

    Every group gets its first row; then rows are taken in the order of their place in their group while all together
    have ``most`` bytes.
    """
    own: dict = {}
    for group, u, n in sorted(sizes):
        own.setdefault(group, []).append((u, n))
    queue = sorted((place, group, u, n) for group, rows in own.items() for place, (u, n) in enumerate(rows))
    taken, total, closed = {}, 0, set()
    for place, group, u, n in queue:
        if place and (group in closed or total + n > most):
            closed.add(group)
            continue
        total += n
        taken[group] = u
    return taken


def train(docs: DataFrame, per_lang: int = PER_LANG, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on a sample of whole texts of all languages, bounded by MOST_ROWS documents and most_bytes of their profiles, or one of each language."""
    found = written(training_rows(docs, per_lang))
    sizes = found.select("lang", "u", F.octet_length("at") + F.octet_length("x")).collect()
    taken = within_bytes([tuple(r) for r in sizes], most_bytes)
    if not taken:
        return Model([], [])
    upto = docs.sparkSession.createDataFrame(list(taken.items()), "lang string, upto long")
    rows = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in found.join(F.broadcast(upto), "lang").filter("u <= upto").select("lang", "at", "x").toLocalIterator())
    return Model([(np.frombuffer(at, np.int32), np.frombuffer(v, np.float16)) for _, at, v in rows], [r[0] for r in rows])


def predict_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of documents, from the whole text alone.

    Without a model one is learned from the documents with a language that aren't held out. Texts that are null, empty
    or without letters are ``und`` with score 0, and so are all if nothing could be learned. Rows without a doc_id are
    held out. Other columns aren't read.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict((t.as_py() or b"").decode("utf-8", "replace")) for t in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return mapped(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("t")), run, "doc_id long, held_out boolean, lang_pred string, score double")
