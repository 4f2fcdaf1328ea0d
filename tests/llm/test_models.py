"""Classifiers by held-out accuracy, mixing by its properties, and the pipeline against brute force."""

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from fixtures import ROWS, docs

import corpus_pipeline
from tidemill.llm import decontam, grams, langid, mixing, quality, tokens
from tidemill.llm.queries import QUERIES
from tidemill.llm.work import table

SF = "/root/testdata/sf0.01"


def test_word_hashes_do_not_depend_on_place():
    a, n = grams.words(np.frombuffer(b"  abc de\tabc\n\nx abc", np.uint8))
    assert n.tolist() == [3, 2, 3, 1, 3] and a[0] == a[2] == a[4] and len(set(a.tolist())) == 3
    long = b"word " * 500_000
    assert sum(map(len, grams.pieces(long))) == len(long) and len(list(grams.pieces(long))) > 1


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_language_svm"](spark, SF).collect()}
    want = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == want[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_cases(spark):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict_languages(docs(spark, clash=True)).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (10, "und")} <= got
    assert {r["lang_pred"] for r in langid.predict_languages(docs(spark, [(1, "text", None, None, 1)])).collect()} == {"und"}
    assert langid.predict_languages(docs(spark, [])).count() == 0
    one = [(i, f"some text {i}", "en", "a", 1) for i in range(20)]
    assert {r["lang_pred"] for r in langid.predict_languages(docs(spark, one)).collect()} == {"en"}
    assert langid.family_of("pt-BR") == "romance" and langid.family_of("xx") == "xx"


def test_more_languages_than_fit_a_small_model(spark):
    rows = []
    for g in range(45):
        own = "abcdefghijklmnopqrstuvwxyz"
        pair = own[g % 26] + own[(g * 7 + g // 26 + 3) % 26]
        rows += [(g * 100 + i, f"{pair * 4} {pair * 3}{own[i]} {pair * 5}", f"x{g:02d}", "a", 1) for i in range(12 if g < 40 else 8)]
    want = {x[0]: x[2] for x in rows}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(docs(spark, rows)).collect()}
    assert set(got.values()) == set(want.values()) and np.mean([got[i] == want[i] for i in want]) > 0.9
    few = langid.training_rows(docs(spark, rows), most_rows=20).groupBy("lang").count().collect()
    assert len(few) == 45


def test_machines_solve_their_problem():
    """Weights against a plain solver in doubles that goes on for long, by the value of what is minimized."""
    rng = np.random.default_rng(2)
    x = []
    for i in range(60):
        at = np.sort(rng.choice(40, 12, False))
        values = rng.random(12) + (at < 20) * (i % 3 == 0) * 0.6
        x.append((at, values / np.linalg.norm(values)))
    y = np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    full = np.zeros((60, 41))  # the buckets in use, and the bias
    for i, (at, values) in enumerate(x):
        full[i, at] = values
    full[:, -1] = 1
    cost = np.where(y > 0, 60 / (2 * 20), 60 / (2 * 40)) * 10
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (full @ w))).sum()
    used = lambda w: np.append(w[:40], w[-1]).astype(float)
    alpha, w = np.zeros(60), np.zeros(41)
    for _ in range(3000):
        for i in range(60):
            new = min(max(alpha[i] - (y[i] * (w @ full[i]) - 1) / (full[i] @ full[i]), 0), cost[i])
            w += (new - alpha[i]) * y[i] * full[i]
            alpha[i] = new
    assert value(w) - (alpha.sum() - 0.5 * w @ w) < 0.01 * value(w)  # the plain solver's own gap
    got = langid.train_svm(langid._with_bias(x), y, rounds=2000)
    assert not got[40:-1].any() and value(used(got)) < 1.01 * value(w)
    assert np.mean(np.sign(full @ used(langid.train_svm(langid._with_bias(x), y))) == np.sign(full @ w)) > 0.93


def test_votes_against_a_plain_count(spark):
    """Family by the greatest margin, then the language of most won pairs, over dense vectors."""
    langs = ["en", "de", "sv", "fr", "es", "fi", "zz"]
    rng = np.random.default_rng(4)
    parts = {v: ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(9)] for v in langs}
    text = lambda v: " ".join(rng.choice(parts[v], 12))
    rows = [(v, text(v)) for v in langs for _ in range(12)]
    model = langid.Model([langid.profile(t) for _, t in rows], [v for v, _ in rows])
    right = 0
    for v, t in [(v, text(v)) for v in langs for _ in range(6)]:
        words = b" " + b" ".join(t.encode().split()) + b" "
        counts = np.zeros(1 << langid.BITS)
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                counts[grams.ngrams(np.frombuffer(words[i : i + n], np.uint8), n, langid.BITS)[0]] += 1
        margins = np.append(np.sqrt(counts / counts.sum()), 1.0) @ model.weights
        names = sorted({langid.family_of(x) for x in langs})
        family = names[int(np.argmax(margins[: len(names)]))]
        own = sorted(x for x in langs if langid.family_of(x) == family)
        won, at = dict.fromkeys(own, 0), len(names) + sum(len(list(combinations([x for x in langs if langid.family_of(x) == f], 2))) for f in names if f < family)
        for a, b in combinations(own, 2):
            won[a if margins[at] > 0 else b] += 1
            at += 1
        best = [x for x in own if won[x] == max(won.values())]
        got = model.predict(t)[0]
        assert got in best
        right += got == v
    assert right > 35 and len(model.weights[0]) == 4 + 3 + 1


def test_training_rows_are_bounded_in_bytes():
    sizes = [("a", u, 10) for u in range(100)] + [("b", 5, 500), ("b", 3, 40), ("c", 9, 10_000)]
    got = langid.within_bytes(sizes, 10_200)
    assert got == {"a": 15, "b": 3, "c": 9} and langid.within_bytes([], 5) == {}


def test_scores_against_averaged_vectors():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["good", "fine", "well", "text"] if i % 2 else ["bad", "junk", "junk", "spam"], 30)) + f" {i}" for i in range(80)] + ["", "x", "same same same"]
    labels = [i % 2 for i in range(80)] + [0, 0, 0]
    bags = [quality.bag(t.encode()) for t in texts]
    vectors, output, bias = quality.learn(bags, labels)
    model = quality.Model(bags, labels)
    for t, q in zip(texts, labels):
        found = np.concatenate(list(quality.hashed(t.encode())))
        average = np.mean([vectors[h].astype(float) for h in found], axis=0)
        z = average @ output.astype(float) + bias
        p = np.exp(z - z.max())
        assert abs(model.score(t.encode()) - p[1] / p.sum()) < 1e-4
    assert np.mean([(model.score(t.encode()) > 0.5) == q for t, q in zip(texts, labels)]) > 0.9


def test_labels_are_never_inputs(spark):
    d = table(spark, SF, "documents")
    model = langid.train(d)
    from pyspark.sql import functions as F

    other = d.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6})
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict_languages(d, model).collect()}
    b = {r["doc_id"] - 10**6: r["lang_pred"] for r in langid.predict_languages(other, model).collect()}
    assert a == b


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_subword"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    good, bad = ([got[i]["score"] for i in held if labels[i] == q] for q in (1, 0))
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.95
    assert np.mean(np.array(good) >= 0.7) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, None, 0), (None, 1, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs(spark, clash=True), labels)
    got = quality.score_documents(docs(spark, clash=True), model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(docs(spark), model, 0.0).count() == len(ROWS)
    assert quality.keep_good(docs(spark), model, 1.1).columns == docs(spark).columns
    empty = quality.train(docs(spark, []), labels.limit(0))
    assert {r["score"] for r in quality.score_documents(docs(spark), empty).collect()} == {0.5}


def filled(sizes, weights=(5, 2, 1)):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **t}
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("group_rows", [4, 1000])
def test_mixing_meets_its_targets(spark, group_rows):
    d = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], {"src3": None, "src4": "src40"}.get(r["source"], "src0" if r["doc_id"] % 3 == 0 else r["source"]), 1) for r in d.collect()]
    df = docs(spark, rows)
    got = mixing.mix(df, group_rows=group_rows).collect()
    again = mixing.mix(df.repartition(7, "text"), group_rows=group_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 3
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        most[s] = max(most[s], r["size"])
    want = filled(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["copies"] in (int(want[s] / sizes[s] + 1e-12), int(want[s] / sizes[s] + 1e-12) + 1)
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 * want[s] + 1 for s in want)
    if group_rows == 1000:
        assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 5 for s in want)
    assert len(got) == len(rows)


def test_mixing_caps_and_cases(spark):
    rows = [(1, "a b c", "en", "a", 1), (2, "x " * 300, "en", "b", 1), (3, "y " * 300, "en", "c", 1), (3, "y " * 300, "en", "c", 1), *ROWS[4:7], (None, "no id here", None, None, 1)]
    got = mixing.taken_words(docs(spark, rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["target"] == 9.0 and by[1]["taken"] == 9
    assert by[4]["taken"] == 0 and by[4]["size"] == 0
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.taken_words(docs(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.taken_words(docs(spark, ROWS[4:7])).collect()} == {0}


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    sizes, p = rng.integers(1, 100, 30), 0.3
    total = np.zeros(30)
    for _ in range(3000):
        rows = []
        pivot = mixing.Pivot(rows)
        for i, s in enumerate(sizes.tolist()):
            pivot.meet(i, p, s, rng.random())
        pivot.end(False)
        x = dict(rows)
        assert len(x) == 30 and sum(0 < v < 1 for v in x.values()) <= 1
        assert abs(sum(x[i] * s for i, s in enumerate(sizes)) - p * sizes.sum()) < 1e-6
        total += [x[i] for i in range(30)]
    assert np.abs(total / 3000 - p).max() < 0.06


def test_repeated_rows_share_their_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LISTED", 40)
    rows = [(7, "one and the same row of words", "en", "a", 1)] * 300 + [(i, f"other words {i}", "en", "b" if i % 2 else "a", 1) for i in range(8, 60)]
    got = mixing.mix(docs(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    own = [r["copies"] for r in got if r["doc_id"] == 7]
    p = got[0]["target"] / got[0]["source_size"]
    assert len(own) == 300 and max(own) - min(own) <= 1 and (abs(sum(own) - 300 * own_share(got, 7)) <= 1)
    kept = Counter(r["doc_id"] for r in mixing.mixed_documents(docs(spark, rows)).collect())
    assert kept[7] == sum(own) and p > 0


def own_share(rows, doc_id):
    r = next(r for r in rows if r["doc_id"] == doc_id)
    return r["target"] / r["source_size"]


def test_mixed_documents(spark):
    kept = mixing.mixed_documents(docs(spark, ROWS, clash=True))
    assert kept.columns == docs(spark, clash=True).columns
    want = Counter()
    for r in mixing.mix(docs(spark, ROWS)).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in kept.collect()) == +want


def test_pipeline_stage_by_stage(spark):
    from test_neighbours import shingles

    docs_now = table(spark, SF, "documents")
    cols = docs_now.columns
    (_, good), (_, near), (_, clean), (_, mix), (_, out) = corpus_pipeline.STAGES
    a = good(spark, docs_now, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    ids = {r["doc_id"] for r in a.collect()}
    assert a.columns == cols and np.mean([(i in ids) == (q == 1) for i, q in labels.items()]) > 0.97
    b = near(spark, a, SF).cache()
    rows = {r["doc_id"]: r["text"] for r in a.collect()}
    left = {r["doc_id"] for r in b.collect()}
    own = {i: shingles(t) for i, t in rows.items()}
    inverse = {}
    for i, s in own.items():
        for x in s:
            inverse.setdefault(x, []).append(i)
    best, missed, close = Counter(), 0, 0
    for i, s in own.items():
        for j, n in Counter(k for x in s for k in inverse[x] if k < i).items():
            sim = n / (len(s) + len(own[j]) - n)
            best[i], best[j] = max(best[i], sim), max(best[j], sim)
            close += sim >= 0.8
            missed += sim >= 0.8 and i in left and j in left
    assert b.columns == cols and close and missed == 0
    assert all(best[i] >= 0.8 for i in rows if i not in left)
    c = clean(spark, b, SF).cache()
    bad = {r["doc_id"] for r in decontam.contained_items(b, table(spark, SF, "benchmark")).collect()}
    assert c.columns == cols and {r["doc_id"] for r in c.collect()} == left - bad and bad
    d = mix(spark, c, SF).cache()
    assert d.columns == cols and set(r["doc_id"] for r in d.select("doc_id").distinct().collect()) <= left - bad
    assert max(Counter(r["doc_id"] for r in d.collect()).values()) <= 3
    e = out(spark, d, SF)
    assert e.count() == d.count()
    got = sorted(tuple(r) for r in e.select("doc_id", "start").collect())
    assert [x[1] for x in got] == sorted(x[1] for x in got)
    assert corpus_pipeline.run(spark, SF).count() == d.count()


AWKWARD = [
    (1, None, None, None, None),
    (2, "", None, None, 0),
    (2, "", None, None, 0),
    (None, "no id but text " * 20, "en", None, 1),
    (None, "no id but text " * 20, "en", None, 1),
    (3, "word " * 200_000, "en", "a", 1),
    (4, "<|endoftext|> in a text\x00 with odd \ufffd bytes", "en", "b", 1),
]


@pytest.mark.parametrize("rows", [[], AWKWARD])
def test_pipeline_on_awkward_tables(spark, tmp_path, rows):
    from fixtures import CLASH, save
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)][: len(rows)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (1, "")][: len(rows)], "item_id long, text string")
    df = docs(spark, rows).withColumns({c: F.lit("mine") for c in [*CLASH, "_row", "_own", "_times"]})
    d = save(tmp_path, spark, documents=df, labels=labels, benchmark=items)
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        kept = out.collect()
        if "token" not in name:
            assert out.columns == df.columns and all(r["mine" if "mine" in out.columns else "x"] == "mine" for r in kept)
            now = spark.createDataFrame(kept, out.schema)
    assert corpus_pipeline.run(spark, d).count() == len(kept)
    assert tokens.read_blocks(spark, spark.conf.get("spark.tidemill.tokens.made")).count() == len(kept)
