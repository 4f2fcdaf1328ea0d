"""SimHash, decontamination and components against brute force."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from fixtures import ROWS, docs
from pyspark.sql import functions as F

from tidemill.llm import decontam, mixing, nearsets, quality, simhash, stars
from tidemill.sources import shared


def groups(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair():
    for radius in (1, 2, 4):
        masks = simhash.covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        r = random.Random(radius)
        for _ in range(2000):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not diff & m for m in masks)
    assert all(20 <= m.bit_count() <= 40 for m in simhash.covering_masks(list(range(64)), 4))


def test_fingerprints_and_components(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 3) for _ in range(60)) for _ in range(6)]
    rows = [*ROWS[4:8], *ROWS[9:11]]
    for i in range(120):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 1)):
            w[r.randrange(len(w))] = "zz"
        rows.append((100 + i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "en", "a", 1))
    got = simhash.near_duplicates(docs(spark, rows, clash=True)).collect()
    fps = [plain_fingerprint(x[1]) for x in rows]
    top = groups(len(rows), [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            least[top[i]] = min(least.get(top[i], x[0]), x[0])
    assert sorted(map(tuple, got), key=str) == sorted(((x[0], f"{fps[i]:016x}", least.get(top[i])) for i, x in enumerate(rows)), key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_fingerprint_holds_most_rows(spark):
    rows = [(i, "", "en", "a", 1) for i in range(400)] + [(1000 + i, "all the same words here", "en", "a", 1) for i in range(400)] + [(5000 + i, f"word{i} a b c d e", "en", "a", 1) for i in range(9)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert len(got) == 809 and {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(400)} == {1000}


@pytest.mark.parametrize("hot", [8, 10**9])
def test_hot_groups_lose_no_link(spark, hot):
    r = np.random.default_rng(5)
    near = np.unique(r.integers(0, 1 << 12, 250).astype(np.uint64) << np.uint64(20) | np.uint64(0xABC))
    far = r.integers(0, 1 << 63, 50).astype(np.uint64)
    fps = np.concatenate([near, far])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = stars.components(simhash.covering_links(df, 2, hot)).collect()
    raw = fps.view(np.int64).tolist()
    top = groups(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 2])
    want = {}
    for i, t in enumerate(top):
        want.setdefault(t, set()).add(raw[i])
    got = {}
    for x in found:
        got.setdefault(x["root"], set()).add(x["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, (v for v in want.values() if len(v) > 1)))


@pytest.mark.parametrize("at_once, salted", [(300_000, 10**9), (0, 10**9), (0, 0)])
def test_components_of_chains_and_stars(spark, monkeypatch, at_once, salted):
    monkeypatch.setattr(stars, "EDGES_AT_ONCE", at_once)
    monkeypatch.setattr(stars, "SALTED_EDGES", salted)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(3, 3), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in stars.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 300)]}, 300: 300, 301: 300}
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.createDataFrame(edges, "a long, b long")
    for held in (3, 1000):
        fewer = stars.forest(df.coalesce(1), held)
        assert {r["node"]: r["root"] for r in stars.components(fewer).collect()} == got and fewer.count() <= len(edges)


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicate_stage(spark):
    """Copies with replaced words, truncated ones and ones with more words behind, all of 0.8 and more."""
    word, r, rows = words_by(9), random.Random(9), []
    for g in range(40):
        w = word(200)
        for k in range(4):
            x = list(w)
            for _ in range(k):
                x[r.randrange(200)] = word(1)[0]
            rows.append((g * 10 + k, " ".join(x), "en", "a", 1))
    for g in range(100, 140):
        w = word((60, 100, 200, 400)[g % 4])
        n = len(w)
        rows += [(g * 10, " ".join(w), "en", "a", 1), (g * 10 + 1, " ".join(w[: int(0.83 * n)]), "en", "a", 1), (g * 10 + 2, " ".join(w + word(int(0.2 * n))), "en", "a", 1)]
    of = {x[0]: x[1] for x in rows}
    assert all(0.8 <= similar(of[i // 10 * 10], of[i]) for i in of) and all(similar(of[i // 10 * 10], of[i]) < 0.86 for i in of if i > 999 and i % 10)
    rows += [(9000, None, "en", "a", 1), (9001, "", "en", "a", 1), (None, rows[0][1], "en", "a", 1), rows[5]]
    kept = nearsets.drop_near_duplicates(docs(spark, rows, clash=True))
    assert kept.columns == docs(spark, clash=True).columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [*(g * 10 for g in range(40)), *(g * 10 for g in range(100, 140)), 9000]
    assert nearsets.drop_near_duplicates(docs(spark, [])).count() == 0


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def words_by(seed):
    r = random.Random(seed)
    return lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def test_stage_removes_by_exact_similarity_alone(spark):
    word, rows, r = words_by(12), [], random.Random(3)
    passage, line = word(60), word(30)
    for i in range(30):
        rows.append((i, " ".join(word(100) + passage * (5 + i % 4)), "en", "a", 1))
        rows.append((100 + i, " ".join(word(100) + line * 20), "en", "a", 1))
        w = word(150)
        for k in range(6):
            x = list(w)
            for at in r.sample(range(150), k * 2 // 2):
                x[at] = "other"
            rows.append((1000 + i * 10 + k, " ".join(x), "en", "a", 1))
    sets = [shingles(x[1]) for x in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    top = groups(len(rows), near)
    least = {}
    for i, x in enumerate(rows):
        least[top[i]] = min(least.get(top[i], x[0]), x[0])
    got = sorted(x["doc_id"] for x in nearsets.drop_near_duplicates(docs(spark, rows)).collect())
    assert near and got == sorted(least.values()) and {*range(30), *range(100, 130)} <= set(got)


@pytest.mark.parametrize("nodes, shingles_held", [(7, 4_000_000), (4096, 900)])
def test_stage_in_blocks_loses_no_link(spark, monkeypatch, nodes, shingles_held):
    """One big group of which only some are near, and chains, in blocks of a few nodes."""
    monkeypatch.setattr(nearsets, "BLOCK_NODES", nodes)
    monkeypatch.setattr(nearsets, "BLOCK_SHINGLES", shingles_held)
    word, r, rows = words_by(21), random.Random(6), []
    own = word(90)
    for i in range(90):
        x = list(own)
        for at in r.sample(range(90), i % 9):
            x[at] = f"z{i}"
        rows.append((i, " ".join(x), "en", "a", 1))
    chain = word(100)
    for i in range(40):
        chain = chain[4:] + word(4)
        rows.append((500 + i, " ".join(chain), "en", "a", 1))
    rows += [(900 + i, " ".join(own[:40] + word(60)), "en", "a", 1) for i in range(30)]
    r.shuffle(rows)
    sets = [shingles(x[1]) for x in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    top = groups(len(rows), near)
    least = {}
    for i, x in enumerate(rows):
        least[top[i]] = min(least.get(top[i], x[0]), x[0])
    got = sorted(x["doc_id"] for x in nearsets.drop_near_duplicates(docs(spark, rows)).collect())
    assert got == sorted(least.values()) and len(got) < len(rows) - 50


def test_blocks_of_keys():
    made = nearsets._Blocks()
    at = lambda n: int(np.log(n) / np.log(nearsets.STEP))
    ids = lambda n, size: np.arange(n) * 4096 + at(size)
    made.add(1, ids(3, 2))
    made.add(2, ids(1, 500))
    made.add(3, ids(10_000, 4_000))
    made.add(3, ids(5, 5_000_000))
    made.end()
    rows = made.rows
    assert rows[0][:3] == (1, 0, False) and {x[0] for x in rows} == {1, 3} and [x[1] for x in rows[1:]] == list(range(len(rows) - 1)) and all(x[2] for x in rows[1:])
    held = [np.frombuffer(x[3], np.int64) for x in rows[1:]]
    assert np.concatenate(held).tolist() == [*ids(10_000, 4_000), *ids(5, 5_000_000)] and max(map(len, held)) <= 4_000_000 // 3_960 and [len(x) for x in held[-5:]] == [1] * 5
    sizes = [1, 2, 100, 110, 180, 1000, 1260, 5000]
    assert [int(x) >> 12 for x in nearsets.of_near_sizes(np.array([i * 4096 + at(n) for i, n in enumerate(sizes)]))] == [2, 3, 5, 6]
    for n in range(1, 3000, 7):  # whatever can be 0.8 similar stays
        m = int(np.ceil(0.8 * n))
        assert len(nearsets.of_near_sizes(np.array([at(n), 4096 + at(m)]))) == 2


def test_maps_tell_large_sets_apart():
    """Sets of 0.8 always pass, also where their maps have two lengths; large ones far below that don't reach the texts."""
    r = np.random.default_rng(4)

    def links(a, b):
        sets = [np.unique(x) for x in (a, b)]
        return list(nearsets._possible([b"a", b"b"], list(map(len, sets)), [nearsets.parity_map(x) for x in sets], [1, 2]))

    for n in (1, 2, 5, 63, 64, 65, 70, 127, 129, 140, 1000, 1025, 1100, 2049, 5000, 70_000):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        more = r.integers(0, 1 << 63, n, dtype=np.uint64)
        assert links(x, x) and links(x, x[: -(-4 * n // 5)]) and links(x, np.concatenate([x, more[: n // 4]])), n
        assert links(np.concatenate([x, more[: n // 9]]), np.concatenate([x, more[n - n // 9 :]])), n
        if n >= 1000:
            assert not links(np.concatenate([x[: n * 3 // 4], more[: n // 4]]), x), n  # 0.6
            assert not links(x, more), n


def test_shuffles_of_the_stage_go_as_actions_end(spark):
    files = lambda: {x for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "/shuffle_" in x}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    try:
        with pytest.raises(ZeroDivisionError), shared.shuffles_freed(spark):
            assert shared.written(spark.range(1000).repartition(3, "id")).count() == 1000
            assert shared.checkpointed(spark.range(1000).groupBy(F.col("id") % 7).count()).count() == 7
            for _ in range(100):
                if not files() - before:
                    break
                time.sleep(0.1)
            assert not files() - before
            raise ZeroDivisionError
    finally:
        assert spark.conf.get(key) == was


def test_columns_keep_their_values(spark):
    from fixtures import CLASH
    from pyspark.sql import functions as F

    names = [*CLASH, "_id", "_row", "_own", "_copy", "_copies", "_times", "_part", "_salt", "times", "stays"]
    df = docs(spark, ROWS).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    model = quality.train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    items = spark.createDataFrame([(1, "words that are in no text at all")], "item_id long, text string").withColumns({n: F.lit("x") for n in names})
    for stage in (nearsets.drop_near_duplicates, mixing.mixed_documents, lambda d: quality.keep_good(d, model, 0.0), lambda d: decontam.keep_clean(d, items)):
        out = stage(df)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
        found = out.collect()
        assert found and all(r[n] == n + str("-" if r["doc_id"] is None else r["doc_id"]) for r in found for n in names)


def test_bytes_that_are_no_text(spark):
    from pyspark.sql import functions as F

    df = docs(spark, ROWS[:3]).withColumn("text", F.concat("text", F.expr("cast(x'ff20fe' as string)")))
    model = quality.train(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    items = spark.createDataFrame([(1, "words that are in no text at all")], "item_id long, text string")
    assert quality.keep_good(df, model, 0.0).count() == 3 and decontam.keep_clean(df, items).count() == 3
    assert nearsets.drop_near_duplicates(df).count() == 3 and mixing.mixed_documents(df).count() >= 3


def test_containment_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(n)).capitalize() + ".") for i, n in enumerate([1, 2, 4, 5, 6, 9, 20, 33, 64, 120] * 4)]
    items += [(98, None), (99, ""), (99, "..."), (3, items[3][1])]
    rows = list(ROWS)
    for i in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            own = r.choice(items)[1] or ""
            own = own.split(" ")
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = r.choice(words)
            at = r.randint(0, len(w))
            w[at:at] = own
        rows.append((1000 + i, "  ".join(w) if i % 3 else "\n".join(w).upper(), "en", "a", 1))
    df = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(x) for x in decontam.contained_items(docs(spark, rows, clash=True), df).collect()), key=str)

    def clean(t):
        return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in t or "").split()

    want, bad = [], set()
    for d, text, *_ in rows:
        w = clean(text)
        for i, own in items:
            o = clean(own)
            n = min(5, len(o))
            s = {tuple(o[k : k + n]) for k in range(len(o) - n + 1)} if o else set()
            shared = len(s & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) if o else 0
            if s and shared >= 0.8 * len(s) - 1e-9:
                want.append((d, i, len(s), shared, round(shared / len(s), 6)))
                bad.add(d)
    assert len(want) > 100 and got == sorted(want, key=str)
    kept = decontam.keep_clean(docs(spark, rows), df)
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted((x[0] for x in rows if x[0] not in bad), key=str)
    assert decontam.contained_items(docs(spark), df.limit(0)).count() == 0 and decontam.contained_items(docs(spark, []), df).count() == 0
    assert decontam.keep_clean(docs(spark), df.limit(0)).count() == len(ROWS)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 8)
    df = spark.createDataFrame([(i, f"some item number {i} with words") for i in range(5)], "item_id long, text string")
    rows = [(i, f"before some item number {i} with words after", "en", "a", 1) for i in range(7)]
    assert sorted((x["doc_id"], x["item_id"]) for x in decontam.contained_items(docs(spark, rows), df).collect()) == [(i, i) for i in range(5)]
    assert sorted(x["doc_id"] for x in decontam.keep_clean(docs(spark, rows), df).collect()) == [5, 6]
    twice = docs(spark, [*rows, (None, "some item number 3 with words", "en", "a", 1), (None, None, "en", "a", 1), *rows[5:]])
    assert sorted((x["doc_id"] for x in decontam.keep_clean(twice, df).collect()), key=str) == [5, 5, 6, 6, None]
    odd = spark.createDataFrame([(None, "some item number 1 with words"), (7, None)], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontam.contained_items(docs(spark, rows), odd).collect()] == [(1, None)]


def test_one_block_is_alive_at_a_time(spark, monkeypatch):
    """Blocks are sent out one after another, each gone before the next, and documents are read once for each."""
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 8)
    alive, most, real = set(), [], spark.sparkContext.broadcast

    def broadcast(value):
        b = real(value)
        alive.add(id(b))
        most.append(len(alive))
        gone = b.destroy
        b.destroy = lambda *a: (alive.discard(id(b)), gone(*a))
        return b

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    df = spark.createDataFrame([(i, f"some item number {i} with words") for i in range(12)], "item_id long, text string")
    rows = [(i, f"before some item number {i} with words after", "en", "a", 1) for i in range(14)]
    found = decontam.contained_items(docs(spark, rows), df)
    assert len(most) == 12 and max(most) == 1 and not alive and found.count() == 12
