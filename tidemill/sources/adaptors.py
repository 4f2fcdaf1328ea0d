"""Tables and text files as samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Samples


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Milliseconds of a TIMESTAMP_NTZ column, floored."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str, with_k: bool = False) -> Samples:
    """Event types as metrics, users as hosts; ``with_k`` adds the tag k, which only events with an even k have."""
    df = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cols = [F.col("event_type").alias("metric"), F.col("user_id").alias("host")]
    promoted = {"host": "host"}
    if with_k:
        cols.append(F.when(k % 2 == 0, k.cast("string")).alias("k"))
        promoted["k"] = "k"
    return Samples(df.select(*cols, millis("ts").alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq"), "ts"), promoted, frozenset({"host"}), time_column="ts")


LINE_METRICS = ("quantity", "extendedprice", "discount", "tax")


def lineitem(spark: SparkSession, sf_dir: str) -> Samples:
    """Four measures as metrics; day-granular, so series have many samples for one t, ordered by what identifies a line."""
    df = read_table(spark, sf_dir, "lineitem")
    measures = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").alias("v")) for m in LINE_METRICS)))
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    x = df.select("l_returnflag", "l_linestatus", "l_suppkey", "l_shipdate", seq.alias("seq"), measures.alias("m"))
    x = x.select(F.col("m.metric").alias("metric"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), F.col("l_suppkey").alias("suppkey"), millis("l_shipdate").alias("t"), F.col("m.v").alias("v"), "seq", F.col("l_shipdate").alias("ts"))
    return Samples(x, {"returnflag": "returnflag", "linestatus": "linestatus", "suppkey": "suppkey"}, frozenset({"suppkey"}), time_column="ts")


def orders(spark: SparkSession, sf_dir: str) -> Samples:
    df = read_table(spark, sf_dir, "orders")
    x = df.select(F.lit("totalprice").alias("metric"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("custkey"), millis("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"))
    return Samples(x, {"status": "status", "priority": "priority", "custkey": "custkey"}, frozenset({"custkey"}), time_column="ts")


# The measurement groups of the devops workload and their metrics.
DEVOPS_GROUPS = {
    "cpu": "usage_user usage_system usage_idle usage_nice usage_iowait usage_irq usage_softirq usage_steal usage_guest usage_guest_nice",
    "diskio": "reads writes read_bytes write_bytes read_time write_time io_time",
    "disk": "total free used used_percent inodes_total inodes_free inodes_used",
    "kernel": "boot_time interrupts context_switches processes_forked disk_pages_in disk_pages_out",
    "mem": "total available used free cached buffered used_percent available_percent buffered_percent",
    "net": "bytes_sent bytes_recv packets_sent packets_recv err_in err_out drop_in drop_out",
    "nginx": "accepts active handled reading requests waiting",
    "postgres": "numbackends xact_commit xact_rollback blks_read blks_hit tup_returned tup_fetched tup_inserted tup_updated tup_deleted conflicts temp_files temp_bytes deadlocks blk_read_time blk_write_time",
    "redis": "uptime_in_seconds total_connections_received expired_keys evicted_keys keyspace_hits keyspace_misses instantaneous_ops_per_sec instantaneous_input_kbps instantaneous_output_kbps connected_clients used_memory used_memory_rss used_memory_peak used_memory_lua rdb_changes_since_last_save sync_full sync_partial_ok sync_partial_err pubsub_channels pubsub_patterns latest_fork_usec connected_slaves master_repl_offset repl_backlog_active repl_backlog_size repl_backlog_histlen mem_fragmentation_ratio used_cpu_sys used_cpu_user used_cpu_sys_children used_cpu_user_children",
}


def devops_metrics() -> list[str]:
    """The workload's metrics: the group's name and the measure's."""
    return [f"{group}_{name}" for group, names in DEVOPS_GROUPS.items() for name in names.split()]


def devops_series(spark: SparkSession, path: str, metrics: list[str] | None = None) -> DataFrame:
    """Rows (metric, tags) from a text file of host lines ``name,k=v,k=v…``, one for each host and metric."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    pair = "struct(substring_index(x, '=', 1) AS key, substring(x, instr(x, '=') + 1) AS value)"
    tags = F.expr(f"map_from_entries(transform(filter(split(value, ','), x -> instr(x, '=') > 0), x -> {pair}))")
    return lines.select(F.explode(F.array(*map(F.lit, metrics or devops_metrics()))).alias("metric"), tags.alias("tags"))


def devops_samples(spark: SparkSession, hosts: int, tuples: int, interval_s: int = 30, per_tuple: int = 32, metrics: list[str] | None = None) -> Samples:
    """The devops workload by formula: per_tuple samples in each tuple, jitter and value from 0 to 199."""
    n = hosts * tuples * per_tuple
    m = metrics or devops_metrics()
    x = spark.range(n).select((F.col("id") % hosts).alias("host"), F.call_function("div", F.col("id"), F.lit(hosts)).alias("i"))
    x = x.select("host", "i", F.explode(F.array(*map(F.lit, m))).alias("metric"))
    jitter = F.pmod(F.xxhash64("host", "i", "metric"), F.lit(200))
    t = F.col("i") * interval_s * 1000 + jitter
    df = x.select("metric", F.concat(F.lit("host_"), F.col("host").cast("string")).alias("hostname"), t.alias("t"), jitter.cast("double").alias("v"), F.col("i").alias("seq"))
    return Samples(df, {"hostname": "hostname"}, unique=True)


def from_maps(df: DataFrame, unique: bool = False) -> Samples:
    """Rows (labels or metric and tags, t, v[, seq]) as samples with their tags in a map; the metric may be among the labels.

    Without a seq the order of rows is that of ingest.
    """
    if "labels" in df.columns:
        df = df.withColumns({"metric": F.coalesce(F.col("labels")["__name__"], F.lit("")), "tags": F.map_filter("labels", lambda k, _: k != "__name__")}).drop("labels")
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.monotonically_increasing_id())
    return Samples(df.select("metric", "tags", "t", "v", "seq"), tags_column="tags", unique=unique)
