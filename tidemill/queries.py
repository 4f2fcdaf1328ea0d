"""The registered queries over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels as L
from .functions import times as T
from .model import METRIC_LABEL, Samples
from .operators import aggregate, index, select as sel, tombstones
from .operators.matchers import Eq, In, Neq, Nre, Re
from .plans import blocks as B
from .plans import tsbs
from .sources import adaptors, blockstore, proto, store, wire
from .sources.shared import scratch, written
from .streaming import streams

END = 1_706_572_800_000  # 2024-01-30T00:00Z
DAY, HOUR = T.DAY_MS, T.HOUR_MS
MINT, MAXT = END - 12 * DAY, END - 2 * DAY
HOSTS = ["8", "1", "2", "3", "4", "5", "6", "7"]
_HOSTS = ", ".join(f"'{h}'" for h in HOSTS)
METRICS = ["click", "view", "purchase", "signup", "error"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "(SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) // 1000 AS t, value AS v, event_id AS seq, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS VARCHAR) END AS k FROM events)"


_NEWEST = f"(SELECT metric, host, t, arg_max(v, seq) AS v FROM {EV} GROUP BY 1, 2, 3)"


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def _rows(samples: Samples, *extra: str) -> DataFrame:
    return samples.df.select("metric", samples.label("host").alias("host"), *extra, "t", "v")


def _select_query(name: str, matchers: list, where: str, mint: int = MINT, maxt: int = MAXT, k: bool = False) -> None:
    extra = ["k"] if k else []

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(sel.select(adaptors.events(spark, sf_dir, k), matchers, mint, maxt), *extra)

    QUERIES[name] = run
    cols = "metric, host, " + ("k, " if k else "")
    ORACLES[name] = f"SELECT {cols}t, arg_max(v, seq) AS v FROM {EV} WHERE ({where}) AND t BETWEEN {max(mint, 0)} AND {maxt} GROUP BY {cols}t"


_click = Eq(METRIC_LABEL, "click")
_select_query("select_eq_range", [_click, Eq("host", "3")], "metric = 'click' AND host = '3'")
_select_query("select_metric_only", [_click], "metric = 'click'")
_select_query("select_in", [In(METRIC_LABEL, ("click", "view")), In("host", tuple(HOSTS))], f"metric IN ('click', 'view') AND host IN ({_HOSTS})")
_select_query("select_neq", [_click, Neq("host", "3")], "metric = 'click' AND host <> '3'")
_select_query("select_regex", [_click, Re("host", "1[0-4]?")], "metric = 'click' AND regexp_full_match(host, '1[0-4]?')")
_select_query("select_not_regex", [Re(METRIC_LABEL, "(click|view)"), Nre("host", ".*[05]")], "regexp_full_match(metric, '(click|view)') AND NOT regexp_full_match(host, '.*[05]')")
_select_query("select_unset_label", [_click, Eq("k", "")], "metric = 'click' AND coalesce(k, '') = ''", k=True)
_select_query("select_unset_label_regex", [_click, Re("k", "(|1.)")], "metric = 'click' AND regexp_full_match(coalesce(k, ''), '(|1.)')", k=True)
_select_query("select_unset_label_neq", [_click, Neq("k", "12")], "metric = 'click' AND coalesce(k, '') <> '12'", k=True)
_select_query("select_set_label", [_click, Neq("k", "")], "metric = 'click' AND coalesce(k, '') <> ''", k=True)
_select_query("select_unknown_label", [_click, Eq("nope", "")], "metric = 'click'")
_select_query("select_no_match", [_click, Eq("host", "no such host")], "1 = 0")
_select_query("select_invalid_regex", [_click, Re("host", "[")], "1 = 0")
_select_query("select_neg_mint", [_click, Eq("host", "3")], "metric = 'click' AND host = '3'", mint=-5)
_select_query("select_no_matchers", [], "1 = 0")


@query(f"SELECT host, t, v FROM {EV} WHERE 1 = 0")
def select_tree_mode_needs_a_tag(spark, sf_dir):
    return _rows(sel.select(adaptors.events(spark, sf_dir), [_click], MINT, MAXT, tree_mode=True)).drop("metric")


@query(f"SELECT metric, host, min(t) AS t, arg_min(v, t) AS v FROM {EV} WHERE metric = 'click' AND t >= {MINT} GROUP BY metric, host")
def seek_first_at_or_after(spark, sf_dir):
    x = sel.select(adaptors.events(spark, sf_dir), [_click])
    return sel.first_at_or_after(x, MINT).select("metric", x.label("host").alias("host"), "t", "v")


@query(f"SELECT metric, host, max(t) AS t, arg_max(v, t) AS v FROM {EV} WHERE metric = 'click' AND t <= {MINT} GROUP BY metric, host")
def as_of_last_at_or_before(spark, sf_dir):
    x = sel.select(adaptors.events(spark, sf_dir), [_click])
    return sel.as_of(x, MINT).select("metric", x.label("host").alias("host"), "t", "v")


def _tiers(spark: SparkSession, sf_dir: str) -> tuple[Samples, Samples]:
    """Two overlapping time slices; the newer one has other values and later ingest numbers."""
    x = adaptors.events(spark, sf_dir)
    old = sel.select(x, [In(METRIC_LABEL, ("click", "view"))], 0, END - 8 * DAY, dedupe=False)
    new = sel.select(x, [In(METRIC_LABEL, ("click", "view"))], END - 15 * DAY, END, dedupe=False)
    return old, new.with_df(new.df.withColumns({"v": F.col("v") * 2, "seq": F.col("seq") + 10**12}))


TIERS = f"(SELECT metric, host, t, v, seq FROM {EV} WHERE metric IN ('click','view') AND t <= {END - 8 * DAY} UNION ALL SELECT metric, host, t, v * 2, seq + 1000000000000 FROM {EV} WHERE metric IN ('click','view') AND t BETWEEN {END - 15 * DAY} AND {END})"


@query(f"SELECT metric, host, t, arg_max(v, seq) AS v FROM {TIERS} GROUP BY metric, host, t")
def merge_dedupe_newest_wins(spark, sf_dir):
    return _rows(sel.merge_sources(*_tiers(spark, sf_dir)))


@query(f"SELECT metric, host, t, v FROM {TIERS}")
def chain_concat_no_dedupe(spark, sf_dir):
    return _rows(sel.concat(*_tiers(spark, sf_dir)))


@query(f"SELECT a.host, a.t, a.v AS left_v, b.v AS right_v FROM (SELECT host, (t // {HOUR}) * {HOUR} AS t, max(v) AS v FROM {EV} WHERE metric = 'click' GROUP BY 1, 2) a JOIN (SELECT host, (t // {HOUR}) * {HOUR} AS t, max(v) AS v FROM {EV} WHERE metric = 'view' GROUP BY 1, 2) b ON a.host = b.host AND a.t = b.t")
def series_arithmetic_join(spark, sf_dir):
    def hourly(metric):
        x = sel.select(adaptors.events(spark, sf_dir), [Eq(METRIC_LABEL, metric)], dedupe=False)
        df = aggregate.bucketed(x, HOUR, "max", ["host"], "v").withColumnRenamed("bucket_ms", "t")
        return Samples(df, {"host": "host"}, unique=True)

    return sel.combine(hourly("click"), hourly("view"), ["host"])


_SRC = """'[{"key":"host","value":"' || host || '"}]'"""
_SERIES = f"(SELECT metric, host, src, CAST(dense_rank() OVER (ORDER BY md5(src), src) AS BIGINT) AS source_id, CAST(dense_rank() OVER (ORDER BY metric) AS INTEGER) AS metric_id FROM (SELECT DISTINCT metric, host, {_SRC} AS src FROM {EV}))"
SERIES = f"(SELECT CAST(row_number() OVER (ORDER BY source_id, metric_id) AS BIGINT) AS series_id, * FROM {_SERIES})"


def _series(spark: SparkSession, sf_dir: str) -> tuple[Samples, DataFrame]:
    x = adaptors.events(spark, sf_dir)
    return x, index.series_table(x)


@query(f"SELECT series_id, source_id, metric_id, metric, host FROM {SERIES}")
def series_dictionary(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return s.select("series_id", "source_id", "metric_id", "metric", x.label("host").alias("host"))


@query(f"SELECT s.series_id, s.source_id, count(*) AS n, max(v) AS max_v FROM {EV} e JOIN {SERIES} s ON s.metric = e.metric AND s.host = e.host GROUP BY 1, 2")
def lookup_join_by_series(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.with_ids(x, s).groupBy("series_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_v"))


@query(f"SELECT series_id FROM {SERIES}")
def postings_all(spark, sf_dir):
    return index.all_postings(_series(spark, sf_dir)[1])


@query(f"SELECT series_id FROM {SERIES} WHERE host = '5'")
def postings_value(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.postings(x, s, "host", "5")


@query(f"SELECT series_id FROM {SERIES} WHERE metric = 'click' AND regexp_full_match(host, '1.*') AND NOT host = '10'")
def postings_intersect(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.intersect_ids(*(index.series_for(x, s, [m]) for m in (_click, Re("host", "1.*"), Neq("host", "10"))))


@query(f"SELECT series_id FROM {SERIES} WHERE metric = 'click' OR host IN ('3', '4')")
def postings_union(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.union_ids(*(index.series_for(x, s, [m]) for m in (_click, Eq("host", "3"), Eq("host", "4"))))


@query(f"SELECT series_id FROM {SERIES} WHERE metric = 'click' AND host <> '3'")
def postings_except(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.except_ids(index.series_for(x, s, [_click]), index.postings(x, s, "host", "3"))


@query(f"SELECT series_id FROM {SERIES} WHERE host <> '3'")
def postings_without(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.without_label(x, s, "host", F.col("host") != 3)


@query(f"SELECT name, value, count(*) AS n FROM (SELECT '__name__' AS name, metric AS value FROM {SERIES} UNION ALL SELECT 'host', host FROM {SERIES}) GROUP BY 1, 2")
def postings_counts(spark, sf_dir):
    return index.postings_counts(*_series(spark, sf_dir))


@query(f"SELECT name, value, n FROM (SELECT *, row_number() OVER (ORDER BY n, md5(name || '=' || value), name || '=' || value, name) AS r, count(*) OVER () AS c FROM (SELECT name, value, count(*) AS n FROM (SELECT '__name__' AS name, metric AS value FROM {SERIES} UNION ALL SELECT 'host', host FROM {SERIES}) GROUP BY 1, 2)) WHERE r <= floor(c * 0.25)")
def coldest_labels(spark, sf_dir):
    return index.coldest(index.postings_counts(*_series(spark, sf_dir)), 0.25)


@query(f"SELECT name, value, count(*) AS n, min(series_id) AS first_id, max(series_id) AS last_id FROM (SELECT '__name__' AS name, metric AS value, series_id FROM {SERIES} UNION ALL SELECT 'host', host, series_id FROM {SERIES}) GROUP BY 1, 2")
def postings_index(spark, sf_dir):
    return _index_summary(index.postings_index(*_series(spark, sf_dir)))


def _index_summary(x: DataFrame) -> DataFrame:
    return x.groupBy("name", "value").agg(F.sum(F.size("ids")).alias("n"), F.min(F.col("ids")[0]).alias("first_id"), F.max(F.element_at("ids", -1)).alias("last_id"))


@query(
    f"SELECT name, value, count(*) AS n, min(series_id) AS first_id, max(series_id) AS last_id FROM (SELECT '__name__' AS name, metric AS value, series_id, host FROM {SERIES} WHERE metric <> 'error' UNION ALL SELECT 'host', host, series_id, host FROM {SERIES} WHERE metric <> 'error')"
    " WHERE host <> '3' AND NOT (name = '__name__' AND value = 'view') GROUP BY 1, 2"
)
def index_upkeep(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    s = written(s)
    first = written(index.postings_index(x, s.filter("metric IN ('click', 'view')")))
    more = index.add_postings(first, x, s.filter("metric <> 'error'"))
    less = index.remove_postings(more, s.filter("host = 3").select("series_id"))
    return _index_summary(index.drop_label(less, METRIC_LABEL, "view"))


@query(f"SELECT series_id, metric, host FROM {SERIES}")
def series_snapshot(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    path = f"{scratch(spark)}/series"
    index.save_series(s, path)
    return index.load_series(spark, path).select("series_id", "metric", x.label("host").alias("host"))


def _mapped(spark: SparkSession, sf_dir: str) -> Samples:
    """The events with all their tags in a map."""
    x = adaptors.events(spark, sf_dir)
    return adaptors.from_maps(x.df.select("metric", x.labels_map().alias("tags"), "t", "v", "seq"))


@query(f"SELECT s.series_id, s.source_id, count(*) AS n, max(v) AS max_v FROM {EV} e JOIN {SERIES} s ON s.metric = e.metric AND s.host = e.host GROUP BY 1, 2")
def lookup_join_map_tags(spark, sf_dir):
    x = _mapped(spark, sf_dir)
    return index.with_ids(x, index.series_table(x)).groupBy("series_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_v"))


@query(f"SELECT metric, host, count(*) AS n, max(v) AS max_v FROM {EV} GROUP BY 1, 2")
def append_known_ids(spark, sf_dir):
    x = _mapped(spark, sf_dir)
    s = written(index.series_table(x))
    rows = index.with_ids(x, s).select("series_id", "t", "v", "seq")
    return store.append_by_id(rows, s).groupBy("metric", F.col("tags")["host"].alias("host")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_v"))


@query("SELECT unnest(['__name__', 'host', 'k']) AS name")
def label_names(spark, sf_dir):
    return index.label_names(adaptors.events(spark, sf_dir, True))


@query(f"SELECT DISTINCT k AS value FROM {EV} WHERE k IS NOT NULL")
def label_values(spark, sf_dir):
    return index.label_values(adaptors.events(spark, sf_dir, True), "k")


@query(f"SELECT DISTINCT unnest([metric, host, '__name__', 'host']) AS symbol FROM {EV}")
def symbols(spark, sf_dir):
    return index.symbols(adaptors.events(spark, sf_dir))


@query(f"SELECT metric, host, CAST(row_number() OVER (ORDER BY metric, host) AS BIGINT) AS rank FROM {SERIES}")
def sorted_postings(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    return index.sorted_by_labels(x, s).select("metric", x.label("host").alias("host"), "rank")


def _workload(spark: SparkSession, sf_dir: str) -> tsbs.Workload:
    return tsbs.Workload(adaptors.events(spark, sf_dir), "host", METRICS, HOSTS, END, tsbs.SPARSE)


def _tsbs(shape: str) -> None:
    metrics, hosts, hours, how, width = tsbs.SHAPES[shape]
    own = f"metric IN ({', '.join(repr(m) for m in METRICS[:metrics])})"
    if hosts is not None:
        own += f" AND host IN ({', '.join(repr(h) for h in HOSTS[:hosts])})"
    lo = 0 if hours is None else END - hours * DAY
    step = HOUR if width == "fine" else DAY
    merged = f"(SELECT metric, host, t, arg_max(v, seq) AS v FROM {EV} WHERE {own} AND t BETWEEN {lo} AND {END} GROUP BY 1, 2, 3)"
    value = "max(v) AS max_v" if how == "max" else "round(avg(v), 6) AS avg_v"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = _workload(spark, sf_dir).run(shape)
        return x.withColumn("avg_v", F.round("avg_v", 6)) if how == "avg" else x

    QUERIES[f"tsbs_{shape}"] = run
    ORACLES[f"tsbs_{shape}"] = f"SELECT metric, host, (t // {step}) * {step} AS bucket_ms, {value} FROM {merged} GROUP BY 1, 2, 3"


for _shape in tsbs.SHAPES:
    _tsbs(_shape)


@query(f"SELECT metric, host, max(t) AS t, arg_max(v, (t, seq)) AS v FROM {EV} WHERE metric = 'click' GROUP BY 1, 2")
def tsbs_lastpoint(spark, sf_dir):
    x = _workload(spark, sf_dir)
    return x.last_points("click").select("metric", x.samples.label("host").alias("host"), "t", "v")


def _high(name: str, hosts: int | None, where: str) -> None:
    @query(f"SELECT metric, host, t, v FROM {EV} WHERE metric = 'click' AND v > 50 AND t <= {END} {where}", name)
    def run(spark, sf_dir):
        x = _workload(spark, sf_dir)
        return x.high("click", 50.0, hosts).select("metric", x.samples.label("host").alias("host"), "t", "v")


_high("tsbs_high_cpu_8", 8, f"AND host IN ({_HOSTS})")
_high("tsbs_high_cpu_all", None, "")


@query(f"SELECT metric, count(*) AS n FROM {EV} WHERE t BETWEEN {MINT} AND {MAXT} AND host IN ({_HOSTS}) GROUP BY 1")
def sample_count(spark, sf_dir):
    x = sel.select(adaptors.events(spark, sf_dir), [In("host", tuple(HOSTS))], MINT, MAXT)
    return x.df.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT min(t) AS min_t, max(t) AS max_t FROM {EV}")
def time_bounds(spark, sf_dir):
    return aggregate.time_bounds(adaptors.events(spark, sf_dir))


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) * 4 AS n, max(greatest(l_extendedprice, l_quantity)) AS max_v FROM lineitem GROUP BY 1, 2")
def group_by_labels(spark, sf_dir):
    return aggregate.grouped_by(adaptors.lineitem(spark, sf_dir), ["returnflag", "linestatus"], {"n": F.count(F.lit(1)), "max_v": F.max("v")})


@query("SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) * 4 AS n FROM lineitem GROUP BY 1, 2")
def group_without_labels(spark, sf_dir):
    return aggregate.grouped_without(adaptors.lineitem(spark, sf_dir), ["suppkey"], {"n": F.count(F.lit(1))})


_LS = "'{__name__=' || metric || ',host=' || host || coalesce(',k=' || k, '') || '}'"


@query(f"SELECT DISTINCT {_LS} AS labels, metric, '{{host+' || host || coalesce('k+' || k, '') || '}}' AS source FROM {EV}")
def labels_string(spark, sf_dir):
    x = adaptors.events(spark, sf_dir, True)
    m = x.labels_map(with_metric=True)
    return x.df.select(L.labels_string(m).alias("labels"), L.metric_of(m).alias("metric"), L.source_group(m).alias("source")).distinct()


@query(f"SELECT DISTINCT '{{__name__=' || metric || ',host=' || host || ',k=' || coalesce(k, 'none') || '}}' AS added, '{{__name__=' || metric || coalesce(',k=' || k, '') || '}}' AS removed FROM {EV}")
def labels_add_del(spark, sf_dir):
    x = adaptors.events(spark, sf_dir, True)
    m = x.labels_map(with_metric=True)
    return x.df.select(L.labels_string(L.add_label(m, "k", "none")).alias("added"), L.labels_string(L.del_label(m, "host")).alias("removed")).distinct()


@query(f"SELECT t, (t // {HOUR}) * {HOUR} + {HOUR} AS range_end, (t // 1800000) AS p FROM {EV} WHERE metric = 'click'")
def range_for_timestamp(spark, sf_dir):
    x = sel.select(adaptors.events(spark, sf_dir), [_click], dedupe=False)
    return x.df.select("t", T.range_for_timestamp(F.col("t"), HOUR).alias("range_end"), T.partition_of(F.col("t"), 1_800_000).alias("p"))


@query(f"SELECT source_id, metric_id, source_id * 512 + metric_id AS series_ref, source_id * 16777216 + metric_id AS chunk_ref, source_id AS back_source, CAST(metric_id AS BIGINT) AS back_metric FROM {SERIES}")
def pack_ids(spark, sf_dir):
    _, s = _series(spark, sf_dir)
    ref = T.pack_series_id(F.col("source_id"), F.col("metric_id"))
    back = T.unpack_series_id(ref)
    return s.select("source_id", "metric_id", ref.alias("series_ref"), T.pack_chunk_id(F.col("source_id"), F.col("metric_id")).alias("chunk_ref"), back[0].alias("back_source"), back[1].alias("back_metric"))


def _stones(df: DataFrame) -> DataFrame:
    """Deletions taken from the data: a day from each error sample, for all metrics of the host."""
    x = df.filter("metric = 'error'").select("host", F.col("t").alias("min_t"), (F.col("t") + DAY).alias("max_t"))
    return x.withColumnRenamed("host", "series_id")


_ST = f"(SELECT CAST(host AS BIGINT) AS series_id, t AS min_t, t + {DAY} AS max_t FROM {EV} WHERE metric = 'error')"
_MERGED = f"(SELECT series_id, min(min_t) AS min_t, max(max_t) AS max_t FROM (SELECT *, sum(n) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN min_t > max(max_t) OVER (PARTITION BY series_id ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM {_ST})) GROUP BY series_id, island)"


@query(f"SELECT * FROM {_MERGED}")
def tombstone_merge(spark, sf_dir):
    return tombstones.coalesce_intervals(_stones(adaptors.events(spark, sf_dir).df))


@query(f"SELECT e.metric, e.host, e.t, e.v FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {_ST} s WHERE s.series_id = CAST(e.host AS BIGINT) AND e.t BETWEEN s.min_t AND s.max_t)")
def tombstone_apply(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    df = x.df.withColumn("series_id", F.col("host"))
    return _rows(x.with_df(tombstones.apply_tombstones(df, _stones(x.df))))


@query(f"SELECT series_id, greatest({MINT}, first_t) AS min_t, least({MAXT}, last_t) AS max_t FROM (SELECT s.series_id, min(t) AS first_t, max(t) AS last_t FROM {EV} e JOIN {SERIES} s ON s.metric = e.metric AND s.host = e.host GROUP BY 1) WHERE first_t <= {MAXT} AND last_t >= {MINT}")
def tombstone_clamp(spark, sf_dir):
    x, s = _series(spark, sf_dir)
    own = index.with_ids(x, s)
    return tombstones.delete_range(own.groupBy("series_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t")), MINT, MAXT)


@query(
    f"SELECT b.*, (SELECT count(*) FROM {_ST} s WHERE (s.min_t // {DAY}) * {DAY} = b.block_id OR (s.max_t // {DAY}) * {DAY} = b.block_id) AS num_tombstones FROM (SELECT (t // {DAY}) * {DAY} AS block_id, min(t) AS min_t, max(t) AS max_t, count(*) AS num_samples,"
    f" count(DISTINCT metric || '/' || host) AS num_series, count(DISTINCT metric || '/' || host || '/' || t // {2 * HOUR}) AS num_chunks FROM {EV} GROUP BY 1) b"
)
def block_stats(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    return B.block_stats(x, DAY, 2 * HOUR, _stones(x.df))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each day, longer by half a day every fifth day; their numbers of error samples stand for tombstones."""
    x = adaptors.events(spark, sf_dir)
    day = T.div(F.col("t"), DAY)
    b = x.df.groupBy(day.alias("block_id")).agg(F.count(F.lit(1)).alias("num_series"), F.count(F.when(F.col("metric") == "error", 1)).alias("num_tombstones"))
    end = (F.col("block_id") + 1) * DAY + F.when(F.col("block_id") % 5 == 0, DAY // 2).otherwise(0)
    return b.withColumns({"min_t": F.col("block_id") * DAY, "max_t": end, "level": F.lit(1)})


BLOCKS = f"(SELECT t // {DAY} AS block_id, (t // {DAY}) * {DAY} AS min_t, (t // {DAY} + 1) * {DAY} + CASE WHEN (t // {DAY}) % 5 = 0 THEN {DAY // 2} ELSE 0 END AS max_t FROM {EV} GROUP BY 1, 2, 3)"
PLAIN = f"(SELECT t // {DAY} AS block_id, (t // {DAY}) * {DAY} AS min_t, (t // {DAY} + 1) * {DAY} AS max_t FROM {EV} GROUP BY 1, 2, 3)"


@query(f"SELECT block_id, min_t, max_t, (min_t // {5 * DAY}) * {5 * DAY} AS group_start FROM {BLOCKS} WHERE max_t <= (min_t // {5 * DAY}) * {5 * DAY} + {5 * DAY}")
def block_split_by_range(spark, sf_dir):
    return B.split_by_range(_blocks(spark, sf_dir), 5 * DAY).select("block_id", "min_t", "max_t", "group_start")


_ISLANDS = f"(SELECT *, sum(n) OVER (ORDER BY min_t, max_t, block_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN min_t >= max(max_t) OVER (ORDER BY min_t, max_t, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {BLOCKS}))"


@query(f"SELECT block_id, group_min, group_max FROM (SELECT block_id, count(*) OVER (PARTITION BY island) AS c, min(min_t) OVER (PARTITION BY island) AS group_min, max(max_t) OVER (PARTITION BY island) AS group_max FROM {_ISLANDS}) WHERE c > 1")
def blocks_overlapping(spark, sf_dir):
    return B.overlapping_blocks(_blocks(spark, sf_dir)).select("block_id", "group_min", "group_max")


@query(f"SELECT block_id, min_t, max_t FROM (SELECT *, min(CASE WHEN c > 1 THEN island END) OVER () AS first FROM (SELECT *, count(*) OVER (PARTITION BY island) AS c FROM {_ISLANDS})) WHERE island = first")
def compaction_plan_overlapping(spark, sf_dir):
    return B.plan(_blocks(spark, sf_dir), [DAY, 5 * DAY, 25 * DAY]).select("block_id", "min_t", "max_t")


@query(
    f"WITH b AS (SELECT * FROM {PLAIN} WHERE min_t < (SELECT max(min_t) FROM {PLAIN})), g AS (SELECT (min_t // {5 * DAY}) * {5 * DAY} AS g, count(*) AS c, min(min_t) AS lo, max(max_t) AS hi FROM b WHERE max_t <= (min_t // {5 * DAY}) * {5 * DAY} + {5 * DAY} GROUP BY 1),"
    f" f AS (SELECT min(g) AS g FROM g WHERE c > 1 AND (hi - lo = {5 * DAY} OR hi <= (SELECT max(min_t) FROM b))) SELECT block_id, min_t, max_t FROM b WHERE (min_t // {5 * DAY}) * {5 * DAY} = (SELECT g FROM f)"
)
def compaction_plan_by_range(spark, sf_dir):
    plain = _blocks(spark, sf_dir).withColumn("max_t", (F.col("block_id") + 1) * DAY)
    return B.plan(plain, [DAY, 5 * DAY, 25 * DAY]).select("block_id", "min_t", "max_t")


@query(f"SELECT min(min_t) AS min_t, max(max_t) AS max_t, 2 AS level, count(*) AS num_sources, min(block_id) AS first_source FROM {BLOCKS}")
def compaction_meta(spark, sf_dir):
    x = B.compacted_meta(_blocks(spark, sf_dir))
    return x.select("min_t", "max_t", "level", F.size("sources").cast("long").alias("num_sources"), F.col("sources")[0].alias("first_source"))


@query(f"SELECT metric, host, t, v FROM (SELECT metric, host, t, arg_max(v, seq) AS v FROM {TIERS} GROUP BY 1, 2, 3) m WHERE NOT EXISTS (SELECT 1 FROM {_ST} s WHERE s.series_id = CAST(m.host AS BIGINT) AND m.t BETWEEN s.min_t AND s.max_t)")
def compaction_result(spark, sf_dir):
    merged = B.compact(list(_tiers(spark, sf_dir)))
    df = tombstones.apply_tombstones(merged.df.withColumn("series_id", F.col("host")), _stones(adaptors.events(spark, sf_dir).df))
    return _rows(merged.with_df(df))


@query(f"SELECT metric, host, t, v FROM {EV} WHERE t >= {MINT}")
def retention_cutoff(spark, sf_dir):
    return _rows(B.retain(adaptors.events(spark, sf_dir), MINT))


@query(f"SELECT metric, count(*) AS n FROM {EV} WHERE t >= (SELECT max(t) FROM {EV}) - {15 * DAY} GROUP BY 1")
def retention_by_age(spark, sf_dir):
    return B.retain_by_age(adaptors.events(spark, sf_dir)).df.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS total_samples, count(*) FILTER (WHERE t < {MINT}) AS dropped_samples, (SELECT count(*) FROM {_ST}) AS total_tombstones, (SELECT count(*) FROM {_ST} WHERE max_t < {MINT}) AS dropped_tombstones FROM {EV}")
def checkpoint_stats(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    return B.checkpoint_stats(x, MINT, _stones(x.df))


def _stored(spark: SparkSession, sf_dir: str) -> Samples:
    """The events as a store, read back from its directories."""
    path = f"{scratch(spark)}/store"
    store.write_samples(adaptors.events(spark, sf_dir), path)
    return store.read_samples(spark, path, {"host": "host"}, frozenset({"host"}))


@query(f"SELECT t // 1800000 AS p, t // {DAY} AS day, count(*) AS n, min(t) AS min_t, max(t) AS max_t FROM {EV} GROUP BY 1, 2")
def partition_layout(spark, sf_dir):
    return _stored(spark, sf_dir).df.groupBy("p", "day").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_t"), F.max("t").alias("max_t"))


@query(f"SELECT metric, host, t, arg_max(v, seq) AS v FROM {EV} WHERE metric = 'click' AND t BETWEEN {MINT} AND {MAXT} GROUP BY 1, 2, 3")
def store_round_trip(spark, sf_dir):
    return _rows(sel.select(_stored(spark, sf_dir), [_click], MINT, MAXT))


def _daily(spark: SparkSession, sf_dir: str, how) -> list[tuple]:
    """A sample for each metric and day, few enough for a session's buffer."""
    x = adaptors.events(spark, sf_dir).df
    rows = x.groupBy("metric", (T.div(F.col("t"), DAY) * DAY).alias("t")).agg(how("v").alias("v")).orderBy("metric", "t").collect()
    return [({METRIC_LABEL: m, "of": "all"}, t, v) for m, t, v in rows]


_DAILY = f"(SELECT metric, (t // {DAY}) * {DAY} AS t, max(v) AS hi, min(v) AS lo FROM {EV} GROUP BY 1, 2)"


@query(f"SELECT metric, CAST(dense_rank() OVER (ORDER BY metric) AS BIGINT) AS series_id, t, CASE WHEN t // {DAY} % 2 = 0 THEN lo ELSE hi END AS v FROM {_DAILY}")
def appender_two_sessions(spark, sf_dir):
    path = f"{scratch(spark)}/store"
    first = store.Appender(spark, path)
    for labels, t, v in _daily(spark, sf_dir, F.max):
        first.add(labels, t, v)
    first.commit()
    second = store.Appender(spark, path)  # knows the series, and is newer
    for labels, t, v in _daily(spark, sf_dir, F.min):
        if t // DAY % 2 == 0:
            second.add_fast(second.ids[tuple(sorted(labels.items()))], t, v)
    second.commit()
    x = sel.merge_newest(second.samples())
    return x.df.join(second.series().select("metric", "series_id"), "metric").select("metric", "series_id", "t", "v")


@query(f"SELECT metric, t, hi AS v FROM {_DAILY}")
def appender_recovered(spark, sf_dir):
    path, log = f"{scratch(spark)}/store", _daily(spark, sf_dir, F.max)
    lost = store.Appender(spark, path)
    for labels, t, v in log[: len(log) // 2]:
        lost.add(labels, t, v - 1)
    lost.commit()
    for labels, t, v in log:
        lost.add(labels, t, v - 2)
    lost.rollback()
    again = store.Appender(spark, path)
    again.recover(log)
    return sel.merge_newest(again.samples()).df.select("metric", "t", "v")


@query("SELECT * FROM (VALUES (1, CAST(1 AS BIGINT), NULL), (2, 1, NULL), (3, NULL, 'unknown series 77'), (4, 2, NULL), (5, NULL, 'ValueError: no labels')) AS x(row, id, error)")
def insert_results(spark, sf_dir):
    a = store.Appender(spark, f"{scratch(spark)}/store")
    rows = [{"labels": {METRIC_LABEL: "m"}, "t": 1, "v": 1.0}, {"id": 1, "t": 2, "v": 2.0}, {"id": 77, "t": 2, "v": 2.0}, {"labels": {METRIC_LABEL: "n"}, "t": 1, "v": 1.0}, {"labels": {}, "t": 1, "v": 0.0}]
    out = [(i, r.get("id"), r.get("error")) for i, r in enumerate(a.insert(rows), 1)]
    return spark.createDataFrame(out, "row int, id long, error string")


@query(f"SELECT t // {DAY} AS day, count(*) AS n, max(v) AS max_v FROM {EV} GROUP BY 1")
def stream_ingest(spark, sf_dir):
    path = scratch(spark)
    s = streams.deduplicated(streams.event_stream(spark, sf_dir), ["metric", "host"])
    streams.ingest(s, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/store").groupBy(F.col("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_v"))


_SIX = 6 * DAY


@query(f"SELECT t // {_SIX} * {_SIX} AS min_t, (t // {_SIX} + 1) * {_SIX} AS max_t, 1 AS level, count(*) AS num_samples, count(DISTINCT metric || '/' || host) AS num_series, count(DISTINCT metric || '/' || host || '/' || t // {2 * HOUR}) AS num_chunks, true AS has_bytes FROM {EV} GROUP BY t // {_SIX}")
def blocks_written(spark, sf_dir):
    root = scratch(spark)
    blockstore.blocks_by_day(adaptors.events(spark, sf_dir), root, 6)
    return blockstore.block_metas(spark, root).select("min_t", "max_t", "level", "num_samples", "num_series", "num_chunks", (F.col("num_bytes") > 0).alias("has_bytes"))


_EVENT_TAGS = {"promoted": {"host": "host"}, "numeric": frozenset({"host"})}


@query(f"SELECT metric, host, t, arg_max(v, seq) AS v, 2 AS level FROM {TIERS} GROUP BY metric, host, t")
def blocks_compacted(spark, sf_dir):
    root = scratch(spark)
    for x in _tiers(spark, sf_dir):
        blockstore.write_block(x, root)
    block = blockstore.compact_next(spark, root, **_EVENT_TAGS)
    metas = blockstore.block_metas(spark, root)
    x = blockstore.block_samples(spark, root, [block], **_EVENT_TAGS)
    return _rows(x).crossJoin(F.broadcast(metas.select("level")))


@query(f"SELECT e.metric, e.host, e.t, e.v FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {_ST} s WHERE s.series_id = CAST(e.host AS BIGINT) AND e.t BETWEEN s.min_t AND s.max_t)")
def block_cleaned(spark, sf_dir):
    root, x = scratch(spark), adaptors.events(spark, sf_dir)
    block = blockstore.write_block(x, root)
    blockstore.delete_from_block(spark, root, block, _stones(x.df))
    block = blockstore.clean_block(spark, root, block, **_EVENT_TAGS, by="host")
    return _rows(blockstore.block_samples(spark, root, [block], **_EVENT_TAGS))


@query(f"SELECT e.metric, e.host, e.t, e.v FROM {EV} e WHERE NOT EXISTS (SELECT 1 FROM {_ST} s WHERE s.series_id = CAST(e.host AS BIGINT) AND e.t BETWEEN s.min_t AND s.max_t)")
def store_rewritten(spark, sf_dir):
    path, x = scratch(spark), adaptors.events(spark, sf_dir)
    store.write_samples(x, f"{path}/store")
    stored = store.read_samples(spark, f"{path}/store", {"host": "host"}, frozenset({"host"}))
    store.rewrite_without(stored.with_df(stored.df.withColumn("series_id", F.col("host"))), _stones(x.df), f"{path}/new")
    store.replace(spark, f"{path}/new", f"{path}/store")
    return _rows(store.read_samples(spark, f"{path}/store", {"host": "host"}, frozenset({"host"})))


@query(f"SELECT * FROM {_MERGED}")
def tombstones_stored(spark, sf_dir):
    path = f"{scratch(spark)}/stones"
    tombstones.write_tombstones(_stones(adaptors.events(spark, sf_dir).df), path)
    return tombstones.read_tombstones(spark, path)


@query(f"SELECT metric, host, t, v FROM {EV} WHERE t >= {MINT} AND metric IN ('click', 'error')")
def checkpoint_kept(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    return _rows(B.checkpoint(x, index.distinct_series(x).filter("metric IN ('click', 'error')"), MINT))


@query(f"WITH b AS (SELECT block_id, min_t, max_t, (SELECT count(*) FROM {EV} WHERE t // {DAY} = block_id) AS num_bytes FROM {PLAIN}), c AS (SELECT *, sum(num_bytes) OVER (ORDER BY min_t DESC, max_t DESC, block_id DESC) AS s, sum(num_bytes) OVER () AS a FROM b) SELECT block_id, num_bytes FROM c WHERE s <= (SELECT count(*) // 2 FROM {EV})")
def retention_by_size(spark, sf_dir):
    n = adaptors.events(spark, sf_dir).df.count()
    x = _blocks(spark, sf_dir).withColumns({"num_bytes": F.col("num_series"), "max_t": (F.col("block_id") + 1) * DAY})
    return B.retain_by_size(x, n // 2).select("block_id", "num_bytes")


@query(f"SELECT metric, count(DISTINCT host) AS sources, count(DISTINCT host) AS by_host, 1 AS by_metric, count(DISTINCT host) AS without_k, 1 AS metrics FROM {EV} GROUP BY 1")
def label_hashes(spark, sf_dir):
    x = adaptors.events(spark, sf_dir, True)
    m = x.labels_map(with_metric=True)
    n = F.count_distinct
    return x.df.groupBy("metric").agg(n(L.source_hash(L.del_label(m, "k"))).alias("sources"), n(L.by_hash(m, ["host"])).alias("by_host"), n(L.by_hash(m, [METRIC_LABEL])).alias("by_metric"), n(L.without_hash(m, ["k"])).alias("without_k"), n(L.metric_hash(m)).alias("metrics"))


@query(f"SELECT metric, host, CASE WHEN (metric, host) < ('purchase', '5') THEN -1 WHEN (metric, host) > ('purchase', '5') THEN 1 ELSE 0 END AS order_to FROM (SELECT DISTINCT metric, host FROM {EV})")
def labels_compared(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    other = L.labels_from_pairs(METRIC_LABEL, "purchase", "host", "5")
    found = index.distinct_series(x)
    return found.select("metric", x.label("host").alias("host"), L.compare_labels(x.labels_map(with_metric=True), other).alias("order_to"))


@query(f"SELECT metric, host, lo + ({END} - lo) // greatest(({END} - lo) // (4 * (hi - lo + 1)), 1) AS chunk_end, lo BETWEEN {MINT} AND {MAXT} AS starts_inside, lo >= 0 AND hi <= {MAXT} AS whole FROM (SELECT metric, host, min(t) AS lo, max(t) AS hi FROM {EV} WHERE t < {END} GROUP BY 1, 2)")
def chunk_ends(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    b = sel.select(x, [Re(METRIC_LABEL, ".*")], 0, END - 1, dedupe=False).df.groupBy("metric", "host").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    span = F.array(F.struct(F.lit(0).cast("long").alias("min_t"), F.lit(MAXT).cast("long").alias("max_t")))
    return b.select("metric", F.col("host").cast("string").alias("host"), T.chunk_end_of(lo, hi, F.lit(END)).alias("chunk_end"), T.in_bounds(lo, MINT, MAXT).alias("starts_inside"), T.is_subrange(lo, hi, span).alias("whole"))


@query("SELECT level, CAST(7200000 * power(5, level - 1) AS BIGINT) AS length FROM (SELECT unnest([1, 2, 3]) AS level)")
def block_range_levels(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(T.block_ranges(2 * HOUR), 1)), "level int, length long")


@query("SELECT 100 AS metrics, count(DISTINCT user_id) AS hosts, count(DISTINCT user_id) * 100 AS series, 9 AS groups FROM events")
def devops_catalogue(spark, sf_dir):
    path = f"{scratch(spark)}/hosts"
    hosts = adaptors.events(spark, sf_dir).df.select("host").distinct()
    hosts.select(F.concat(F.lit("cpu,hostname=host_"), F.col("host").cast("string"), F.lit(",region=eu"))).write.text(path)
    x = adaptors.devops_series(spark, path)
    n = F.count_distinct
    return x.agg(n("metric").cast("int").alias("metrics"), n(F.col("tags")["hostname"]).alias("hosts"), F.count(F.lit(1)).alias("series"), n(F.substring_index("metric", "_", 1)).cast("int").alias("groups"))


@query(f"SELECT metric, host, max(t) AS t, arg_max(v, (t, seq)) AS v FROM {EV} WHERE metric = 'click' AND t <= {END} GROUP BY 1, 2")
def tsbs_lastpoint_walk(spark, sf_dir):
    x = _workload(spark, sf_dir)
    series = written(index.distinct_series(x.samples).filter("metric = 'click'"))
    return x.recent_points("click", series, DAY).select("metric", x.samples.label("host").alias("host"), "t", "v")


REQUEST = {
    "queries": [
        {"start_timestamp_ms": MINT, "end_timestamp_ms": MAXT, "matchers": [{"type": "EQ", "name": METRIC_LABEL, "value": "click"}, {"type": "EQ", "name": "host", "value": "3"}]},
        {"start_timestamp_ms": 0, "end_timestamp_ms": MINT, "matchers": [{"type": "RE", "name": METRIC_LABEL, "value": "view|error"}, {"type": "NEQ", "name": "host", "value": "4"}]},
        {"start_timestamp_ms": -10, "end_timestamp_ms": MAXT, "matchers": [{"type": "EQ", "name": METRIC_LABEL, "value": "signup"}, {"type": "NRE", "name": "host", "value": "[1-9].*"}]},
    ]
}


@query(
    f"SELECT 0 AS query, metric, host, t, v FROM {EV} WHERE metric = 'click' AND host = '3' AND t BETWEEN {MINT} AND {MAXT} UNION ALL SELECT 1, metric, host, t, v FROM {EV} WHERE metric IN ('view', 'error') AND host <> '4' AND t <= {MINT}"
    f" UNION ALL SELECT 2, metric, host, t, v FROM {EV} WHERE metric = 'signup' AND NOT regexp_full_match(host, '[1-9].*') AND t <= {MAXT}"
)
def remote_read_multi(spark, sf_dir):
    x = wire.read_request(adaptors.events(spark, sf_dir), REQUEST)
    return x.withColumn("host", F.col("host").cast("string"))


_READ = ORACLES["remote_read_multi"]


@query(_READ)
def remote_read_proto(spark, sf_dir):
    x = wire.read_request(adaptors.events(spark, sf_dir), proto.read_body(REQUEST))
    return x.withColumn("host", F.col("host").cast("string"))


@query(f"SELECT metric, host, t, v FROM {_NEWEST}")
def remote_write_proto(spark, sf_dir):
    found = wire.write_bodies(wire.bodies_of(sel.merge_newest(adaptors.events(spark, sf_dir))))
    return found.df.select("metric", found.label("host").alias("host"), "t", "v")


@query(f"SELECT metric, host, t, v FROM {EV}")
def remote_write_flatten(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    labels = F.array(F.struct(F.lit(METRIC_LABEL).alias("name"), F.col("metric").alias("value")), F.struct(F.lit("host").alias("name"), x.label("host").alias("value")))
    points = F.array_sort(F.collect_list(F.struct(F.col("t").alias("timestamp"), F.col("v").alias("value"))))
    series = x.df.groupBy(labels.alias("labels")).agg(points.alias("samples"))
    lines = series.select(F.to_json(F.struct(F.array(F.struct("labels", "samples")).alias("timeseries"))).alias("value"))
    found = wire.write_requests(lines)
    return found.df.select("metric", found.label("host").alias("host"), "t", "v")


@query(f"SELECT metric, host, t - lag(t) OVER w AS dt, round(v - lag(v) OVER w, 6) AS dv, t FROM {_NEWEST} WINDOW w AS (PARTITION BY metric, host ORDER BY t)")
def series_deltas(spark, sf_dir):
    x = sel.merge_newest(adaptors.events(spark, sf_dir))
    return aggregate.deltas(x).select("metric", x.label("host").alias("host"), "dt", F.round("dv", 6).alias("dv"), "t")


_LINES = "(SELECT unnest([{'m': 'quantity', 'v': l_quantity}, {'m': 'extendedprice', 'v': l_extendedprice}, {'m': 'discount', 'v': l_discount}, {'m': 'tax', 'v': l_tax}], recursive := true), l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(l_suppkey AS VARCHAR) AS suppkey, epoch_us(l_shipdate) // 1000 AS t, l_orderkey * 8 + l_linenumber AS seq FROM lineitem)"
_MID = 852_076_800_000  # 1997-01-01T00:00Z


@query(f"SELECT m AS metric, returnflag, linestatus, suppkey, t, arg_max(v, (seq, v)) AS v FROM {_LINES} WHERE m = 'quantity' AND suppkey IN ('1', '2', '3') AND t <= {_MID} GROUP BY 1, 2, 3, 4, 5")
def lineitem_unpivot_select(spark, sf_dir):
    x = adaptors.lineitem(spark, sf_dir)
    # lines share an order and a number in places: the greater value is the newer one there
    x = x.with_df(x.df.withColumn("seq", F.struct("seq", "v")))
    found = sel.select(x, [Eq(METRIC_LABEL, "quantity"), In("suppkey", ("1", "2", "3"))], 0, _MID)
    return found.df.select("metric", "returnflag", "linestatus", found.label("suppkey").alias("suppkey"), "t", "v")


@query(f"SELECT o_orderstatus AS status, (epoch_us(o_orderdate) // 1000 // {30 * DAY}) * {30 * DAY} AS bucket_ms, max(o_totalprice) AS max_v, count(*) AS n FROM orders GROUP BY 1, 2")
def orders_series_monthly(spark, sf_dir):
    x = adaptors.orders(spark, sf_dir)
    return x.df.groupBy("status", T.bucket(F.col("t"), 30 * DAY).alias("bucket_ms")).agg(F.max("v").alias("max_v"), F.count(F.lit(1)).alias("n"))


_MARK = f"(SELECT max(t) - {2 * HOUR} FROM {EV})"  # what lies behind it is settled


@query(f"SELECT * FROM (SELECT metric, host, (t // {HOUR}) * {HOUR} AS bucket_ms, max(v) AS max_v, count(*) AS n FROM {EV} GROUP BY 1, 2, 3) WHERE bucket_ms + {HOUR} <= {_MARK}")
def stream_window_max(spark, sf_dir):
    s = streams.window_max(streams.event_stream(spark, sf_dir), ["metric", "host"], "1 hour")
    return streams.drained(s, scratch(spark)).withColumn("host", F.col("host").cast("string"))


@query(f"SELECT DISTINCT metric, host, t FROM {EV}")
def stream_dedupe(spark, sf_dir):
    s = streams.deduplicated(streams.event_stream(spark, sf_dir), ["metric", "host"]).select("metric", F.col("host").cast("string").alias("host"), "t")
    return streams.drained(s, scratch(spark))


@query(f"SELECT metric, host, t, v FROM {EV} WHERE t <= {END}")
def hot_and_cold_view(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    hot = sel.select(x, [Re(METRIC_LABEL, ".*")], MINT, END, dedupe=False)
    cold = sel.select(x, [Re(METRIC_LABEL, ".*")], 0, MAXT, dedupe=False)
    return _rows(streams.hot_and_cold(cold, hot, (MINT + MAXT) // 2))


@query(f"SELECT metric, host, max(v) AS max_v FROM {EV} GROUP BY 1, 2 ORDER BY max_v DESC, metric, CAST(host AS BIGINT) LIMIT 10")
def top_series(spark, sf_dir):
    return aggregate.top_series(adaptors.events(spark, sf_dir), 10).withColumn("host", F.col("host").cast("string"))


@query(f"SELECT metric, host, (t // {5 * DAY}) * {5 * DAY} AS chunk, min(t) AS min_t, max(t) AS max_t, count(*) AS num_samples FROM {EV} GROUP BY 1, 2, 3 HAVING min(t) <= {MAXT} AND max(t) >= {MINT}")
def chunks_in_range(spark, sf_dir):
    x = B.chunks_in_range(B.chunk_metas(adaptors.events(spark, sf_dir), 5 * DAY), MINT, MAXT)
    return x.withColumn("host", F.col("host").cast("string"))


@query(f"SELECT metric, host, min_t, max_t FROM (SELECT metric, host, t // {DAY} AS d, min(t) AS min_t, max(t) AS max_t FROM {EV} GROUP BY 1, 2, 3) c WHERE NOT EXISTS (SELECT 1 FROM {_MERGED} s WHERE s.series_id = CAST(c.host AS BIGINT) AND s.min_t <= c.min_t AND c.max_t <= s.max_t)")
def chunks_not_deleted(spark, sf_dir):
    x = adaptors.events(spark, sf_dir)
    chunks = B.chunk_metas(x, DAY).withColumn("series_id", F.col("host"))
    return tombstones.live_chunks(chunks, _stones(x.df)).select("metric", F.col("host").cast("string").alias("host"), "min_t", "max_t")


@query(f"SELECT DISTINCT host AS value FROM {EV} WHERE host BETWEEN '10' AND '2'")
def label_values_between(spark, sf_dir):
    return index.values_between(adaptors.events(spark, sf_dir), "host", "10", "2")


@query(f"SELECT DISTINCT host AS value FROM {EV} WHERE starts_with(host, '1')")
def label_values_prefix(spark, sf_dir):
    return index.values_with_prefix(adaptors.events(spark, sf_dir), "host", "1")


@query(f"SELECT '{{__name__=' || metric || ',host=' || host || '}}' AS labels, t, v FROM {_NEWEST}")
def nested_series_round_trip(spark, sf_dir):
    x = sel.unnested(sel.nested(sel.merge_newest(adaptors.events(spark, sf_dir))))
    return x.select(L.labels_string(F.col("labels")).alias("labels"), "t", "v")


@query(f"SELECT * FROM (SELECT metric, host, (t // {HOUR}) * {HOUR} - o * {HOUR} AS bucket_ms, max(v) AS max_v, count(*) AS n FROM {EV}, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2, 3) WHERE bucket_ms + {2 * HOUR} <= {_MARK}")
def stream_sliding_max(spark, sf_dir):
    s = streams.window_max(streams.event_stream(spark, sf_dir), ["metric", "host"], "2 hours", slide="1 hour")
    return streams.drained(s, scratch(spark)).withColumn("host", F.col("host").cast("string"))


_GAP = 6 * HOUR


@query(f"SELECT metric, host, min(t) AS start_ms, max(t) + {_GAP} AS end_ms, count(*) AS n, max(v) AS max_v FROM (SELECT *, sum(f) OVER (PARTITION BY metric, host ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY metric, host ORDER BY us) <= {_GAP * 1000} THEN 0 ELSE 1 END AS f FROM (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS host, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS t, value AS v FROM events))) GROUP BY metric, host, s HAVING max(us) + {_GAP * 1000} <= {_MARK} * 1000")
def stream_sessions(spark, sf_dir):
    s = streams.sessions(streams.event_stream(spark, sf_dir), ["metric", "host"], "6 hours")
    return streams.drained(s, scratch(spark)).withColumn("host", F.col("host").cast("string"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima for each day of one metric of eight hosts."""
    found = sel.select(adaptors.events(spark, sf_dir), [_click, In("host", tuple(HOSTS))], 0, END, dedupe=False)
    return aggregate.bucketed(found, DAY, "max", ["host"], "max_v")


QUERIES["flagship_daily_max"] = flagship
ORACLES["flagship_daily_max"] = f"SELECT metric, host, (t // {DAY}) * {DAY} AS bucket_ms, max(v) AS max_v FROM (SELECT metric, host, t, arg_max(v, seq) AS v FROM {EV} WHERE metric = 'click' AND host IN ({_HOSTS}) AND t <= {END} GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"
