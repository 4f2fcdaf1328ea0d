"""Semantics on small fixtures: ranges, matchers, merging, ordering, tombstones, blocks, ingest and wire requests."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions import labels as L
from tidemill.functions import times as T
from tidemill.model import METRIC_LABEL, SAMPLES_SCHEMA, Samples, empty_samples
from tidemill.operators import index, tombstones
from tidemill.operators import select as sel
from tidemill.operators.aggregate import bucketed, last_point, rates
from tidemill.operators.matchers import Eq, In, Neq, Not, Nre, Re, parse_matcher
from tidemill.plans import blocks as B
from tidemill.plans import tsbs
from tidemill.sources import adaptors, blockstore, proto, store, wire
from tidemill.streaming import streams

M = Eq(METRIC_LABEL, "m")


def samples(spark, rows):
    """Rows (labels, t, v[, seq])."""
    data = [(r[0].get(METRIC_LABEL, ""), {k: v for k, v in r[0].items() if k != METRIC_LABEL}, r[1], float(r[2]), r[3] if len(r) > 3 else i) for i, r in enumerate(rows)]
    return Samples(spark.createDataFrame(data, SAMPLES_SCHEMA), tags_column="tags")


def points(s: Samples):
    return sorted((r["t"], r["v"]) for r in s.df.collect())


@pytest.fixture(scope="module")
def two(spark):
    """Three samples with the tag h and one series without it."""
    return samples(spark, [({METRIC_LABEL: "m", "h": "a"}, t, v) for t, v in ((0, 1), (10, 2), (20, 3))] + [({METRIC_LABEL: "m"}, 5, 9)])


def test_range_is_closed_and_starts_at_zero(two):
    q = [M, Eq("h", "a")]
    assert points(sel.select(two, q, 10, 20)) == [(10, 2.0), (20, 3.0)]
    assert points(sel.select(two, q, -5, 10)) == [(0, 1.0), (10, 2.0)]
    assert points(sel.select(two, q, 21, 20)) == []


@pytest.mark.parametrize(
    "matcher, unset, other",
    [
        (Neq("h", "a"), True, False), (Re("h", ".*"), True, True), (Re("h", "a|"), True, True), (Eq("nope", ""), True, True), (Neq("nope", "x"), True, True),
        (Eq("h", ""), True, False), (Neq("h", ""), False, True), (Nre("h", "a"), True, False), (Nre("h", ".*"), False, False), (In("h", ("", "a")), True, True),
        (Not(Not(Eq("h", "a"))), False, True), (Re("h", "["), False, False), (Eq("nope", "x"), False, False),
    ],
)
def test_unset_labels(two, matcher, unset, other):
    got = {t for t, _ in points(sel.select(two, [M, matcher]))}
    assert (5 in got) == unset
    assert ({0, 10, 20} <= got) == other


def test_no_matchers_select_nothing_and_the_metric_alone_selects_all(two):
    assert points(sel.select(two, [])) == []
    assert len(points(sel.select(two, [M]))) == 4
    assert points(sel.select(two, [M], tree_mode=True)) == []
    assert len(points(sel.select(two, [M, Eq("h", "a")], tree_mode=True))) == 3


def test_regex_is_a_full_match(spark):
    s = samples(spark, [({METRIC_LABEL: "m", "h": h}, i, i) for i, h in enumerate(("a", "abc", "xab"))])
    hit = lambda p: [t for t, _ in points(sel.select(s, [M, Re("h", p)]))]
    assert hit("a") == [0] and hit("ab.*") == [1] and hit("a|xab") == [0, 2] and hit("[") == []
    assert hit("(?P<x>a)") == [] and hit("(?<x>a)") == [0]
    line = samples(spark, [({METRIC_LABEL: "m", "h": "a\n"}, 0, 0)])
    assert points(sel.select(line, [M, Re("h", "a")])) == []


def test_modular_labels(spark):
    rows = [({METRIC_LABEL: "cpu", **{f"label_{k}": f"value_{i % 2**k}" for k in range(1, 5)}}, i, i) for i in range(100)]
    s = samples(spark, rows)
    assert index.series_table(s).count() == 16
    for k in range(1, 5):
        got = [t for t, _ in points(sel.select(s, [Eq(METRIC_LABEL, "cpu"), Eq(f"label_{k}", "value_1")]))]
        assert got == [i for i in range(100) if i % 2**k == 1]
    both = points(sel.select(s, [Eq(METRIC_LABEL, "cpu"), Eq("label_1", "value_1"), Eq("label_3", "value_3")]))
    assert [t for t, _ in both] == [i for i in range(100) if i % 8 == 3]


def test_newest_wins_and_concatenation_keeps_all(spark):
    lab = {METRIC_LABEL: "m", "h": "a"}
    s = samples(spark, [(lab, 10, 1, 1), (lab, 10, 9, 2)])
    assert points(sel.select(s, [M])) == [(10, 9.0)]
    assert points(sel.select(s, [M], dedupe=False)) == [(10, 1.0), (10, 9.0)]
    old, new = samples(spark, [(lab, t, t, 1) for t in range(5)]), samples(spark, [(lab, t, -t, 2) for t in range(3, 8)])
    assert points(sel.merge_sources(old, new)) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, -3.0), (4, -4.0), (5, -5.0), (6, -6.0), (7, -7.0)]
    assert len(points(sel.concat(old, new))) == 10


def test_values_pass_bit_by_bit(spark):
    lab = {METRIC_LABEL: "m"}
    vals = [math.nan, 0.0, -0.0, math.inf, -math.inf, 1e308]
    s = samples(spark, [(lab, 1_625_387_863_000 + i, v) for i, v in enumerate(vals)])
    got = [v for _, v in points(sel.select(s, [M]))]
    assert [v.hex() for v in got] == [v.hex() for v in vals]


def test_sets_that_read_alike_stay_apart(spark):
    s = samples(spark, [({METRIC_LABEL: "m", "a": "1b+2"}, 0, 1), ({METRIC_LABEL: "m", "a": "1", "b": "2"}, 0, 2), ({METRIC_LABEL: "m", "ab": "c"}, 0, 3), ({METRIC_LABEL: "m", "a": "bc"}, 0, 4)])
    assert index.series_table(s).count() == 4
    assert len(points(sel.select(s, [M]))) == 4


def test_ids_have_no_gaps(spark):
    s = samples(spark, [({METRIC_LABEL: m, "a": str(i)}, 0, 1) for m in "mn" for i in range(20)])
    t = index.series_table(s).collect()
    assert sorted(r["series_id"] for r in t) == list(range(1, 41)) and sorted({r["source_id"] for r in t}) == list(range(1, 21)) and {r["metric_id"] for r in t} == {1, 2}
    assert len({(r["tags"]["a"], r["source_id"]) for r in t}) == 20


def test_samples_of_tags_in_a_map_get_their_own_ids(spark):
    s = samples(spark, [({METRIC_LABEL: "m", "h": "a"}, 0, 1), ({METRIC_LABEL: "m", "h": "b"}, 0, 2), ({METRIC_LABEL: "m"}, 0, 3)])
    got = index.with_ids(s, index.series_table(s)).collect()
    assert len(got) == 3 and len({r["series_id"] for r in got}) == 3


def test_ranks_in_many_buckets(spark, monkeypatch):
    from tidemill.operators import ranks

    monkeypatch.setattr(ranks, "CUTS", 7)
    df = spark.createDataFrame([(f"k{i * 37 % 200:03d}",) for i in range(200)], "k string")
    assert [r["r"] for r in ranks.ranked_in_order(df, "r", F.col("k")).orderBy("k").collect()] == list(range(1, 201))
    assert sorted(r["r"] for r in ranks.ranked_by_digest(df, "r", F.col("k")).collect()) == list(range(1, 201))
    assert ranks.ranked_in_order(df.limit(0), "r", F.col("k")).count() == 0


def test_order_of_label_sets(spark):
    s = samples(spark, [({METRIC_LABEL: "m", "a": "2"}, 0, 1), ({METRIC_LABEL: "m", "a": "1", "b": "1"}, 0, 2), ({METRIC_LABEL: "m", "a": "1"}, 0, 3)])
    x = index.sorted_by_labels(s, index.series_table(s)).orderBy("rank")
    assert [r["tags"] for r in x.collect()] == [{"a": "1"}, {"a": "1", "b": "1"}, {"a": "2"}]


def test_empty_samples(spark):
    e = empty_samples(spark)
    assert points(sel.select(e, [M])) == [] and index.label_names(e).count() == 1 - 1 and index.series_table(e).count() == 0


def intervals(spark, rows):
    return spark.createDataFrame([(1, a, b) for a, b in rows], "series_id long, min_t long, max_t long")


def test_tombstones_coalesce(spark):
    got = lambda rows: sorted((r["min_t"], r["max_t"]) for r in tombstones.coalesce_intervals(intervals(spark, rows)).collect())
    assert got([(5, 9), (10, 12), (20, 25), (0, 30)]) == [(0, 30)]
    assert got([(5, 9), (10, 12)]) == [(5, 12)]
    assert got([(5, 9), (11, 12)]) == [(5, 9), (11, 12)]
    assert got([(9, 5)]) == []


def test_tombstones_apply_and_clamp(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(31)] + [(2, 7, 0.0)], "series_id long, t long, v double")
    kept = tombstones.apply_tombstones(df, intervals(spark, [(5, 9), (10, 12), (25, 1 << 60)]))
    assert sorted(r["t"] for r in kept.filter("series_id = 1").collect()) == [*range(5), *range(13, 25)]
    assert kept.filter("series_id = 2").count() == 1
    bounds = spark.createDataFrame([(1, 10, 20), (2, 100, 200)], "series_id long, first_t long, last_t long")
    assert [tuple(r) for r in tombstones.delete_range(bounds, 5, 15).collect()] == [(1, 10, 15)]


def test_rewriting_keeps_the_layout(spark, tmp_path):
    lab = {METRIC_LABEL: "m", "h": "a"}
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    store.write_samples(samples(spark, [(lab, d * T.DAY_MS + i, i) for d in range(3) for i in range(10)]), a)
    s = store.read_samples(spark, a, {}, tags_column="tags")
    own = s.with_df(s.df.withColumn("series_id", F.lit(1).cast("long")))
    store.rewrite_without(own, intervals(spark, [(0, 4)]), b)
    with pytest.raises(ValueError, match="already"):
        store.rewrite_without(own, intervals(spark, [(0, 4)]), a)
    store.replace(spark, b, a)
    back = store.read_samples(spark, a, {}, tags_column="tags")
    assert back.df.count() == 25 and sorted(p.name for p in (tmp_path / "a").glob("day=*")) == ["day=0", "day=1", "day=2"] and not (tmp_path / "b").exists() and not (tmp_path / "a.old").exists()


def test_days_are_files_by_their_size(spark, tmp_path):
    hot = [({METRIC_LABEL: "m", "h": "hot"}, i * 400_000, i) for i in range(200)] + [({METRIC_LABEL: "m", "h": str(i)}, T.DAY_MS + i, i) for i in range(5)]
    store.write_samples(samples(spark, hot), str(tmp_path / "s"), rows_a_file=40)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "s").glob("day=*")}
    assert files["day=1"] == 1 and 2 <= files["day=0"] <= 5
    assert store.read_samples(spark, str(tmp_path / "s"), {}, tags_column="tags").df.count() == 205
    store.write_samples(empty_samples(spark), str(tmp_path / "none"))


def test_sessions_go_on_where_the_store_is(spark, tmp_path):
    path, lab = str(tmp_path / "s"), {METRIC_LABEL: "m", "h": "a"}
    one = store.Appender(spark, path)
    i = one.add(lab, 10, 1.0)
    one.add(lab, 10, 2.0)
    one.commit()
    two = store.Appender(spark, path)
    assert two.ids == one.ids and two.add({METRIC_LABEL: "m", "h": "b"}, 1, 1.0) == i + 1
    two.add_fast(i, 10, 99.0)
    two.commit()
    assert points(sel.select(store.Appender(spark, path).samples(), [M, Eq("h", "a")])) == [(10, 99.0)]
    store.append_table(wire.write_request(spark, {"timeseries": [{"labels": [{"name": METRIC_LABEL, "value": "m"}, {"name": "h", "value": "a"}], "samples": [{"timestamp": 10, "value": 7.0}, {"timestamp": 10, "value": 8.0}]}]}), path)
    assert points(sel.select(store.Appender(spark, path).samples(), [M, Eq("h", "a")])) == [(10, 8.0)]
    assert store.Appender(spark, path).insert([{"id": 1, "t": 3, "v": 1.0}, {"id": 9, "t": 3, "v": 1.0}, {"labels": lab, "t": "x", "v": 1}]) == [{"id": 1}, {"error": "unknown series 9"}, {"error": "ValueError: invalid literal for int() with base 10: 'x'"}]


def test_packed_ids_that_do_not_fit_fail(spark):
    lit = lambda x: F.lit(x).cast("long")
    for bad in (T.pack_chunk_id(lit(1 << 40), lit(0)), T.pack_chunk_id(lit(1), lit(1 << 24)), T.pack_series_id(lit(1), lit(512)), T.pack_series_id(lit(-1), lit(1))):
        with pytest.raises(Exception, match="beyond"):
            spark.range(1).select(bad).collect()
    top = T.pack_chunk_id(lit((1 << 40) - 1), lit((1 << 24) - 1))
    assert list(spark.range(1).select(*T.unpack_chunk_id(top)).head()) == [(1 << 40) - 1, (1 << 24) - 1]


def blocks(spark, rows):
    cols = "block_id long, min_t long, max_t long, failed boolean, num_series long, num_tombstones long, level int"
    return spark.createDataFrame([(i, r[0], r[1], bool(r[2]) if len(r) > 2 else False, 100, r[3] if len(r) > 3 else 0, 1) for i, r in enumerate(rows, 1)], cols)


def ids(df):
    return sorted(r["block_id"] for r in df.collect())


def test_split_by_range(spark):
    b = blocks(spark, [(0, 10), (10, 20), (50, 60), (90, 100)])
    got = B.split_by_range(b, 30).groupBy("group_start").agg(F.sort_array(F.collect_list("block_id")).alias("x")).orderBy("group_start").collect()
    assert [r["x"] for r in got] == [[1, 2], [3], [4]]
    assert [r["group_start"] for r in B.split_by_range(blocks(spark, [(-5, 0), (-35, -31), (-5, 5)]), 30).orderBy("min_t").collect()] == [-60, -30]


def test_plans(spark):
    r = [10, 30, 90]
    assert ids(B.plan(blocks(spark, [(0, 10), (5, 12), (12, 20), (18, 25), (40, 50)]), r)) == [1, 2]
    assert ids(B.plan(blocks(spark, [(0, 10), (10, 20), (20, 30), (30, 40)]), r)) == [1, 2, 3]
    assert ids(B.plan(blocks(spark, [(0, 10), (10, 20)]), r)) == []
    assert ids(B.plan(blocks(spark, [(0, 10), (20, 30), (60, 70)]), r)) == [1, 2]
    assert ids(B.plan(blocks(spark, [(0, 10, True), (10, 20), (20, 30), (30, 40)]), r)) == []
    assert ids(B.plan(blocks(spark, [(0, 30, False, 6), (30, 60, False, 1), (60, 90)]), [10, 30, 30])) == [1]
    assert ids(B.overlapping_blocks(blocks(spark, [(0, 10), (5, 12), (12, 20), (18, 25), (40, 50)]))) == [1, 2, 3, 4]
    assert B.overlapping_blocks(blocks(spark, [(0, 10), (5, 12), (12, 20), (18, 25)])).select("group_min").distinct().count() == 2


def test_compacted_meta_and_retention(spark):
    m = B.compacted_meta(blocks(spark, [(0, 10), (5, 40), (12, 20)])).head()
    assert (m["min_t"], m["max_t"], m["level"], m["sources"]) == (0, 40, 2, [1, 2, 3])
    sized = blocks(spark, [(0, 10), (10, 20), (20, 30)]).withColumn("num_bytes", F.lit(40))
    assert ids(B.retain_by_size(sized, 100)) == [2, 3]


def test_label_functions(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", METRIC_LABEL: "m"},)], "m map<string,string>")
    c = F.col("m")
    one = lambda x: df.select(x.alias("x")).head()["x"]
    assert one(L.labels_string(c)) == "{__name__=m,a=1,b=2}"
    assert one(L.labels_string(L.add_label(c, "a", "9"))) == "{__name__=m,a=1,b=2}"
    assert one(L.labels_string(L.add_label(c, "0", "9"))) == "{0=9,__name__=m,a=1,b=2}"
    assert one(L.labels_string(L.del_label(c, "a"))) == "{__name__=m,b=2}"
    assert one(L.source_group(c)) == "{a+1b+2}" and one(L.metric_of(c)) == "m"
    assert one(L.drop_labels(c, ["a"])) == {"b": "2"} and one(L.keep_labels(c, ["a"])) == {"a": "1"}
    assert one(L.labels_from_pairs("a", "1", "b")) == {} and one(L.labels_from_pairs("a", "1")) == {"a": "1"}
    assert one(L.compare_labels(c, L.del_label(c, "b"))) == 1 and one(L.compare_labels(c, c)) == 0
    assert one(L.by_hash(c, ["a", "zz"]) == L.by_hash(L.del_label(c, "b"), ["a"]))


def test_time_functions(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).head()["x"]
    lit = lambda x: F.lit(x).cast("long")
    assert one(T.range_for_timestamp(lit(25), 10)) == 30 and one(T.div(lit(-7), 3)) == -2 and one(T.floor_range(lit(-7), 3)) == -9
    assert T.block_ranges(7_200_000) == [7_200_000, 36_000_000, 180_000_000]
    assert T.chunk_end(0, 9, 100) == 50 and T.chunk_end(0, 99, 100) == 100
    packed = T.pack_chunk_id(lit(5), lit(7))
    assert one(packed) == 5 << 24 | 7 and [one(x) for x in T.unpack_chunk_id(packed)] == [5, 7]
    spans = F.array(F.struct(lit(0).alias("min_t"), lit(10).alias("max_t")))
    assert one(T.is_subrange(lit(2), lit(10), spans)) and not one(T.is_subrange(lit(2), lit(11), spans))


def test_appender(spark, tmp_path):
    a = store.Appender(spark, str(tmp_path / "s"))
    lab = {METRIC_LABEL: "m", "h": "a"}
    i = a.add(lab, 1, 1.0)
    a.add_fast(i, 2, 2.0)
    assert a.add({METRIC_LABEL: "m", "h": "b"}, 1, 5.0) == i + 1
    assert a.commit() == 3
    j = a.add({METRIC_LABEL: "m", "h": "c"}, 3, 3.0)
    a.rollback()
    assert a.commit() == 0 and j == i + 2 and a.series().count() == 3
    with pytest.raises(store.UnknownSeries):
        a.add_fast(99, 1, 1.0)
    a.recover([(lab, 2, 7.0)])
    assert points(sel.select(a.samples(), [M, Eq("h", "a")])) == [(1, 1.0), (2, 7.0)]
    by_id = store.append_by_id(spark.createDataFrame([(i, 9, 1.0, 1)], "series_id long, t long, v double, seq long"), a.series())
    assert by_id.head()["tags"] == {"h": "a"}


def test_select_prunes_the_store(spark, tmp_path):
    lab = [({METRIC_LABEL: "m", "h": "a"}, d * T.DAY_MS + 5, d) for d in range(4)]
    s = samples(spark, lab)
    store.append_table(s, str(tmp_path / "p"))
    back = store.read_samples(spark, str(tmp_path / "p"), {}, tags_column="tags")
    plan = lambda x: x.df._jdf.queryExecution().executedPlan().toString()
    found = sel.select(back, [M], T.DAY_MS, 2 * T.DAY_MS, dedupe=False)
    assert "PartitionFilters: [isnotnull(day" in plan(found) and "GreaterThanOrEqual(p," in plan(found)
    assert points(found) == [(T.DAY_MS + 5, 1.0)]
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(B.retain(back, 2 * T.DAY_MS))) and points(B.retain(back, 2 * T.DAY_MS)) == [(2 * T.DAY_MS + 5, 2.0), (3 * T.DAY_MS + 5, 3.0)]
    assert points(B.retain_by_age(back, T.DAY_MS)) == [(2 * T.DAY_MS + 5, 2.0), (3 * T.DAY_MS + 5, 3.0)]


def test_retention_reaches_the_scan(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    for y in (B.retain(x, 10**12), B.retain_by_age(x), streams.hot_and_cold(x, x, 10**12)):
        plan = y.df._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(ts," in plan


def test_ranges_reach_the_scan_and_aggregation_takes_one_shuffle(spark, sf_dir):
    x = sel.select(adaptors.events(spark, sf_dir), [Eq(METRIC_LABEL, "click"), Eq("host", "3")], 10**12, 2 * 10**12, dedupe=False)
    df = bucketed(x, T.HOUR_MS, "max", ["host"], "max_v")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan and "EqualTo(event_type,click)" in plan and "EqualTo(user_id,3)" in plan
    assert plan.count("Exchange ") == 1 and "props" not in plan


def test_wire_round_trip(spark):
    req = {"timeseries": [{"labels": [{"name": METRIC_LABEL, "value": "m"}, {"name": "h", "value": str(i)}], "samples": [{"timestamp": t, "value": float(i)} for t in range(0, 1010, 10)]} for i in range(10)]}
    s = wire.write_request(spark, req)
    assert s.df.count() == 1010
    ask = {"queries": [{"start_timestamp_ms": 0, "end_timestamp_ms": 1000, "matchers": [{"type": "EQ", "name": METRIC_LABEL, "value": "m"}]}, {"start_timestamp_ms": 0, "end_timestamp_ms": 5, "matchers": [{"type": "NEQ", "name": "h", "value": "3"}, {"type": "RE", "name": "h", "value": "[34]"}]}]}
    a, b = wire.read_response(s, ask)
    assert len(a["timeseries"]) == 10 and all(len(x["samples"]) == 101 for x in a["timeseries"])
    assert [x["labels"][1]["value"] for x in b["timeseries"]] == ["4"]
    assert wire.read_request(s, ask).filter("query = 1").count() == 1
    assert wire.read_request(s, {"queries": []}).count() == 0 and list(wire.read_response(s, {"queries": []})) == []
    assert wire.read_request(s, ask)._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1
    twice = {"timeseries": [{"labels": [{"name": "a", "value": "1"}, {"name": "a", "value": "2"}, {"name": METRIC_LABEL, "value": "m"}], "samples": [{"timestamp": 1, "value": 1.0}]}]}
    assert wire.write_request(spark, twice).df.head()["tags"] == {"a": "1"}
    with pytest.raises(ValueError):
        parse_matcher({"name": "a", "op": "~~", "value": ""})


def test_protobuf_messages(spark):
    """Ten series of 101 samples, written and read as clients do."""
    req = {"timeseries": [{"labels": [{"name": METRIC_LABEL, "value": "m"}, {"name": "h", "value": str(i)}], "samples": [{"value": float(i), "timestamp": t * T.HOUR_MS} for t in range(101)]} for i in range(10)]}
    body = proto.write_body(req)
    assert proto.parse_write(body) == req
    s = wire.write_bodies(spark.createDataFrame([(body,), (None,), (proto.write_body({"timeseries": []}),)], "value binary"))
    assert s.df.count() == 1010
    ask = {"queries": [{"start_timestamp_ms": -5, "end_timestamp_ms": 10**10, "matchers": [{"type": "EQ", "name": METRIC_LABEL, "value": "m"}, {"type": "NRE", "name": "h", "value": "[1-9]"}]}]}
    assert proto.parse_read(proto.read_body(ask)) == ask
    got = proto.parse_response(wire.read_answer(s, proto.read_body(ask)))["results"][0]["timeseries"]
    assert len(got) == 1 and [x["timestamp"] for x in got[0]["samples"]] == [t * T.HOUR_MS for t in range(101)]
    assert [len(x["samples"]) for _, x in wire.read_series(s, ask)] == [24, 24, 24, 24, 5]
    odd = {"timeseries": [{"labels": [{"name": "", "value": "é"}], "samples": [{"value": v, "timestamp": t} for v, t in ((math.inf, -1), (-0.0, 2**62), (1e-300, 0))]}]}
    assert proto.parse_write(proto.write_body(odd)) == odd
    for i in range(len(body)):
        for bad in (body[:i], body[:i] + b"\xff" + body[i + 1 :]):
            try:
                proto.parse_write(bad)
            except proto.Malformed:
                pass


def test_blocks_on_disk(spark, tmp_path):
    root, lab = str(tmp_path / "blocks"), {METRIC_LABEL: "m", "h": "a"}
    rows = lambda ts, v, seq: samples(spark, [(lab, t, v, seq) for t in ts])
    a = blockstore.write_block(rows(range(0, 20, 2), 1, 1), root, bounds=(0, 20))
    b = blockstore.write_block(rows(range(10, 30, 2), 2, 2), root, bounds=(10, 30))
    (tmp_path / "blocks" / "half" / "chunks").mkdir(parents=True)  # a write that was lost before its metadata
    metas = {r["block_id"]: r for r in blockstore.block_metas(spark, root).collect()}
    assert set(metas) == {a, b} and (metas[a]["num_samples"], metas[a]["num_series"], metas[a]["num_chunks"], metas[a]["level"]) == (10, 1, 1, 1) and metas[a]["num_bytes"] > 0
    c = blockstore.compact_next(spark, root, {}, tags_column="tags")
    m = blockstore.block_metas(spark, root).collect()
    assert [(r["block_id"], r["level"], r["min_t"], r["max_t"], sorted(r["sources"]), sorted(r["parents"])) for r in m] == [(c, 2, 0, 30, sorted([a, b]), sorted([a, b]))]
    assert points(blockstore.block_samples(spark, root, [c], {}, tags_column="tags")) == [(t, 1.0 if t < 10 else 2.0) for t in range(0, 30, 2)]
    assert blockstore.compact_next(spark, root, {}, tags_column="tags") is None and blockstore.block_metas(spark, str(tmp_path / "none")).count() == 0


def test_last_points_are_looked_for_backwards(spark):
    s = samples(spark, [({METRIC_LABEL: "m", "h": h}, t, t) for h, t in (("a", 990), ("a", 100), ("b", 700), ("c", 3), ("d", 2000))])
    s = s.with_df(s.df.withColumn("h", F.col("tags")["h"]).drop("tags"), promoted={"h": "h"}, tags_column=None)
    w = tsbs.Workload(s, "h", ["m"], [], 1000)
    got = {r["h"]: r["t"] for r in w.recent_points("m", index.distinct_series(s), 50).collect()}
    assert got == {"a": 990, "b": 700, "c": 3}


def test_last_point_rates_and_nested(spark):
    lab = {METRIC_LABEL: "m", "h": "a"}
    s = samples(spark, [(lab, 0, 1, 1), (lab, 1000, 5, 2), (lab, 3000, 9, 3), (lab, 3000, 11, 4)])
    assert last_point(s).head()["v"] == 11.0
    assert [r["rate"] for r in rates(sel.merge_newest(s)).orderBy("t").collect()] == [None, 4.0, 3.0]
    n = sel.nested(sel.merge_newest(s)).head()
    assert [tuple(p) for p in n["samples"]] == [(0, 1.0), (1000, 5.0), (3000, 11.0)] and n["labels"] == lab


def test_devops_sources(spark, tmp_path):
    p = tmp_path / "hosts.txt"
    p.write_text("cpu,hostname=host_0,region=eu=1\ncpu,hostname=host_1,region=us\n\n")
    x = adaptors.devops_series(spark, str(p), ["cpu_0", "cpu_1"])
    assert x.count() == 4 and x.filter("tags['region'] = 'eu=1'").count() == 2
    s = adaptors.devops_samples(spark, hosts=2, tuples=1, metrics=["cpu_0"])
    assert s.df.count() == 64 and s.df.filter("v < 0 OR v >= 200").count() == 0
    assert len(adaptors.devops_metrics()) == len(set(adaptors.devops_metrics())) == 100 and {"cpu_usage_user", "redis_used_cpu_user_children", "nginx_waiting"} <= set(adaptors.devops_metrics())


def test_streams(spark, tmp_path):
    lab = {METRIC_LABEL: "m", "h": "a"}
    s = samples(spark, [(lab, T.DAY_MS + t * 600_000, t) for t in range(12)] + [(lab, T.DAY_MS, 0)])
    s.df.write.parquet(str(tmp_path / "in"))
    st = streams.sample_stream(spark, str(tmp_path / "in")).withColumn("h", F.col("tags")["h"])
    q = streams.ingest(streams.deduplicated(st, ["metric", "h"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    w = streams.drained(streams.window_max(st, ["metric", "h"], "1 hour", late="0 seconds"), str(tmp_path / "w"))
    assert sorted((r["bucket_ms"], r["max_v"]) for r in w.collect()) == [(T.DAY_MS, 5.0)]
    late = samples(spark, [(lab, 2 * T.DAY_MS, 1)])
    late.df.write.mode("append").parquet(str(tmp_path / "in"))
    w = streams.drained(streams.window_max(st, ["metric", "h"], "1 hour", late="0 seconds"), str(tmp_path / "w"))  # goes on where it was
    assert sorted((r["bucket_ms"], r["max_v"]) for r in w.collect()) == [(T.DAY_MS, 5.0), (T.DAY_MS + 3_600_000, 11.0)]
    g = streams.drained(streams.sessions(st, ["metric", "h"], "20 minutes"), str(tmp_path / "g"))
    assert [(r["n"], r["start_ms"]) for r in g.collect()] == [(13, T.DAY_MS)]


def test_snapshots(spark, tmp_path, two):
    s = index.series_table(two)
    index.save_series(s, str(tmp_path / "series"))
    assert index.load_series(spark, str(tmp_path / "series")).count() == s.count() == 2
    tombstones.write_tombstones(intervals(spark, [(0, 5), (6, 9), (20, 30)]), str(tmp_path / "stones"))
    assert sorted((r["min_t"], r["max_t"]) for r in tombstones.read_tombstones(spark, str(tmp_path / "stones")).collect()) == [(0, 9), (20, 30)]
    chunks = spark.createDataFrame([(1, 0, 9), (1, 8, 12), (2, 0, 9)], "series_id long, min_t long, max_t long")
    stones = intervals(spark, [(0, 5), (6, 9)])
    assert tombstones.covered_chunks(chunks, stones).count() == 1 and tombstones.live_chunks(chunks, stones).count() == 2


def test_blocks_are_read_together(spark, tmp_path):
    lab = {METRIC_LABEL: "m", "h": "a"}
    for i, rows in enumerate(([(lab, 0, 1, 1), (lab, 5, 1, 2)], [(lab, 5, 2, 3)])):
        store.write_samples(samples(spark, rows), str(tmp_path / str(i)))
    both = store.read_blocks(spark, [str(tmp_path / "0"), str(tmp_path / "1")], {}, tags_column="tags")
    assert points(sel.select(both, [M])) == [(0, 1.0), (5, 2.0)]


def test_command_line(spark, tmp_path, capsys):
    import json

    from tidemill.__main__ import main

    write, read = tmp_path / "w.json", tmp_path / "r.json"
    write.write_text(json.dumps({"timeseries": [{"labels": [{"name": METRIC_LABEL, "value": "m"}], "samples": [{"timestamp": 1, "value": 2.5}]}]}))
    read.write_text(json.dumps({"queries": [{"start_timestamp_ms": 0, "end_timestamp_ms": 9, "matchers": [{"name": METRIC_LABEL, "op": "=", "value": "m"}]}]}))
    main(["write", "--store", str(tmp_path / "s"), "--request", str(write)])
    main(["read", "--store", str(tmp_path / "s"), "--request", str(read)])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"query": 0, "labels": [{"name": METRIC_LABEL, "value": "m"}], "samples": [{"timestamp": 1, "value": 2.5}]}
