"""Line dedup and URL filters against SQL and small models."""

import hashlib

import duckdb
from fixtures import LINE, ROWS, docs, save
from oracle import rows

from tidemill.llm import linkrank, lines


def test_lines_match_a_model(spark):
    got = sorted((tuple(r) for r in lines.line_digests(docs(spark, clash=True)).collect()), key=str)
    strip, lower = " \t\n\x0b\f\r", str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    keys, own = {}, []
    for i, text, *_ in ROWS:
        x = (text or "").split("\n")
        own.append((i, x, [k.strip(strip).translate(lower) for k in x]))
        for k in own[-1][2]:
            keys.setdefault(k, set()).add(-(2**63) if i is None else i)
    want = []
    for i, x, ks in own:
        here = -(2**63) if i is None else i
        kept = [v for v, k in zip(x, ks) if len(k) < 20 or len(keys[k]) < 3 or max(keys[k]) == here]
        want.append((i, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert lines.line_digests(docs(spark, [])).count() == 0


def test_bitmaps_are_runs(spark):
    text = "\n".join([LINE, LINE, "keep", LINE, "keep", "keep", LINE])
    df = docs(spark, [(i, text, "en", "a", 1) for i in (1, 2, 3)])
    got = {r["doc"]: r for r in lines.keep_bitmaps(df).collect()}
    assert sorted(got) == [1, 2]
    assert [tuple(x) for x in got[1]["dropped"]] == [(0, 2), (3, 1), (6, 1)] and got[1]["n_dropped"] == 4
    assert got[1]["keep_bitmap"].hex() == "0000000000000002" + "0000000300000001" + "0000000600000001"
    kept = {r["doc_id"]: r["kept"] for r in lines.dedup_lines(df).collect()}
    assert kept == {1: "keep\nkeep\nkeep", 2: "keep\nkeep\nkeep", 3: text}


def test_lines_match_sql(spark, tmp_path):
    d = save(tmp_path, spark, documents=docs(spark, [r for r in ROWS if r[0] is not None][:3] + ROWS[4:10]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(lines.ORACLE)
    df = lines.line_digests(spark.read.parquet(f"{d}/documents.parquet"))
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def page(i, url, *links):
    return (i, url, "<html>" + "".join(f'<p>x</p><a class=x href="{h}">y</a>' for h in links) + "</html>")


PAGES = [
    page(1, "http://good.example.com/fr/1", "https://Fine.example.org/a", "http://good.example.com/self", "/local"),
    page(2, "http://good.example.com/fr/2", "//fine.example.org/b?x", "http://fine.example.org"),
    page(3, "https://fine.example.org/en/1", "http://good.example.com/"),
    page(4, "https://spam.example.org/en/1", "http://bad.example.net/es/1", "http://bad.example.net/es/2"),
    page(5, "https://spam.example.org/en/2", "http://bad.example.net/es/1"),
    page(6, "http://bad.example.net/es/1"),
    page(7, "http://bad.example.net/fr/2"),
    page(8, "http://bad.example.net/de/2"),
    page(9, "HTTP://WWW.Example.COM/en/x?q#f"),
    page(10, "http://x.example.com/en/"),
    page(11, "http://example.com"),
    page(12, "no scheme"),
    (13, None, None),
    (14, "http:///path", ""),
    page(14, "ftp://a.b@evilcom:80/p#://x"),
    page(15, "http://lonely.example.org/"),
]


def test_rules_and_links(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in linkrank.judge_urls(df).collect()}
    assert len(got) == 15
    assert (got[9]["host"], got[9]["path"], got[9]["rule"], got[9]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[10]["rule"], got[10]["verdict"]) == ("example.com/en/", "block")
    assert (got[11]["host"], got[11]["path"], got[11]["rule"]) == ("example.com", "", None)
    assert (got[12]["host"], got[13]["host"], got[13]["path"], got[13]["verdict"]) == ("", "", "", "allow")
    assert (got[6]["rule"], got[7]["rule"], got[8]["rule"]) == ("net/es/", "net/fr/", None)
    # a host that only links to a blocked one is distrusted, one that trusted hosts link to isn't
    assert (got[4]["verdict"], got[5]["verdict"], got[3]["verdict"], got[15]["verdict"], got[8]["verdict"]) == ("block", "block", "allow", "allow", "block")
    d = save(tmp_path, spark, pages=df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    rel = con.sql(linkrank.oracle())
    x = linkrank.judge_urls(df)
    assert rows(x.columns, x.collect()) == rows(rel.columns, rel.fetchall())
    assert linkrank.judge_urls(df.limit(0)).count() == 0


def solved(links, seeds, col):
    """Ranks by a linear solve: r = seed + 0.85 M r."""
    import numpy as np

    names = sorted({x for a, b, _ in links for x in (a, b)} | {s[0] for s in seeds})
    m = np.zeros((len(names), len(names)))
    for a, b, n in links:
        i, j = names.index(a), names.index(b)
        if col == "trust":
            m[j, i] += n
        else:
            m[i, j] += n
    m /= np.maximum(m.sum(axis=0), 1e-300)
    s = np.zeros(len(names))
    for h, t, d in seeds:
        s[names.index(h)] += t if col == "trust" else d
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - 0.85 * m, s)))


def test_ranks_match_a_linear_solve(spark):
    import random

    r = random.Random(3)
    small = [("a", "b", 1), ("a", "c", 3), ("b", "c", 1), ("c", "a", 1), ("d", "c", 2)], [("a", 1.0, 0.0), ("d", 0.0, 2.0), ("e", 0.5, 0.5)]
    ring = [(f"h{i:02d}", f"h{(i + 1) % 40:02d}", 1) for i in range(40)]  # mass goes round and round: settles slowly
    hub = [("hub", f"x{i}", r.randint(1, 5)) for i in range(300)] + [(f"x{i}", "hub", 1) for i in range(0, 300, 2)] + [(f"x{i}", f"x{(i * 7) % 300}", 2) for i in range(1, 300, 3) if i != i * 7 % 300]
    for links, seeds in (small, (ring, [("h00", 10.0, 0.0), ("h20", 0.0, 50.0)]), (hub, [("hub", 5.0, 1.0), ("x5", 0.0, 7.0)])):
        got = {x["host"]: x for x in linkrank.propagate(spark.createDataFrame(seeds, "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, n long"), 0.05).collect()}
        for col in ("trust", "distrust"):
            want = solved(links, seeds, col)
            assert set(got) == set(want) and sum(abs(got[h][col] - v) for h, v in want.items()) < 0.05


def test_ranks_that_do_not_settle_fail(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(linkrank, "MOST_ROUNDS", 8)
    with pytest.raises(RuntimeError, match="settle"):
        linkrank.propagate(spark.createDataFrame([("a", 1e6, 0.0)], "host string, trust double, distrust double"), spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, n long"))


def test_hot_hosts_and_odd_columns(spark):
    from pyspark.sql import functions as F

    rows = [page(i, "http://hot.example.net/es/1") for i in range(300)] + [page(300 + i, "http://hot.example.net/other") for i in range(100)] + [page(500, "http://long.example.org/" + "x" * 200_000), page(501, "http://" + "y" * 100_000), (502, "", None)] * 2
    names = ["host", "path", "rule", "verdict", "action", "pages", "trust", "n", "c", "_salt", "by_host"]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit("mine") for n in names})
    got = linkrank.judge_urls(df).collect()
    assert len(got) == len(rows) and {x["verdict"] for x in got if x["page_id"] < 400} == {"block"} and {x["verdict"] for x in got if x["page_id"] >= 500} == {"allow"}


def test_skewed_joins_lose_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemill.llm import work

    monkeypatch.setattr(work, "HOT_SHARE", 0.1)
    monkeypatch.setattr(work, "SMALL", 0)
    big = spark.createDataFrame([(k, i) for i in range(500) for k in ([7] if i < 300 else [8] if i < 400 else [i])], "k long, i long")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.min("k") * 2).alias("twice")).filter("k % 5 <> 1")
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small.drop("n"), "k", how).collect()))
        assert sorted(map(str, work.skew_join(big, small, ["k"], "n", 500, how).collect())) == want
