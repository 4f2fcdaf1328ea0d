"""Continuous ingest and aggregation with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import DAY_MS, div
from ..model import PARTITION_MS, Samples
from ..operators.select import concat, merge_newest, time_filter

LATE = "2 hours"


def event_stream(spark: SparkSession, directory: str, glob: str = "events.parquet", files_per_batch: int = 16) -> DataFrame:
    """The events table as a stream of samples (metric, host, ts, t, v, seq); ts is a TIMESTAMP, as watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    ts = F.col("ts").cast("timestamp")
    return raw.select(F.col("event_type").alias("metric"), F.col("user_id").alias("host"), ts.alias("ts"), F.unix_millis(ts).alias("t"), F.col("value").alias("v"), F.col("event_id").alias("seq"))


def sample_stream(spark: SparkSession, directory: str, files_per_batch: int = 16) -> DataFrame:
    """Files of samples (metric, tags, t, v, seq) dropped into a directory."""
    raw = spark.readStream.schema("metric string, tags map<string,string>, t long, v double, seq long").option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    return raw.withColumn("ts", F.timestamp_millis("t"))


def deduplicated(stream: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """One row for each series and time; state goes once the watermark has passed."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([*keys, "t"])


def window_max(stream: DataFrame, keys: list[str], width: str, late: str = LATE, slide: str | None = None) -> DataFrame:
    """The greatest value of each series and time window, tumbling or sliding."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = stream.withWatermark("ts", late).groupBy(*keys, w.alias("w")).agg(F.max("v").alias("max_v"), F.count(F.lit(1)).alias("n"))
    return x.select(*keys, F.unix_millis("w.start").alias("bucket_ms"), "max_v", "n")


def sessions(stream: DataFrame, keys: list[str], gap: str, late: str = LATE) -> DataFrame:
    """Runs of samples of a series with no gap longer than ``gap``."""
    x = stream.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max_v"))
    return x.select(*keys, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n", "max_v")


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream to the store, day by day, exactly once by the query's checkpoint."""
    x = stream.withColumns({"p": div(F.col("t"), PARTITION_MS), "day": div(F.col("t"), DAY_MS)}).drop("ts")
    return x.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(**(trigger or {"availableNow": True})).start()


def drained(df: DataFrame, path: str) -> DataFrame:
    """What the stream has settled by now, through Parquet files under ``path``: rows are appended once the watermark is past them, so no state stays behind."""
    q = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def hot_and_cold(cold: Samples, hot: Samples, boundary: int) -> Samples:
    """Stored samples before the boundary and streamed ones from it on, the newest kept where tiers overlap; both bounds reach the files."""
    return merge_newest(concat(cold.with_df(time_filter(cold, 0, boundary - 1)), hot.with_df(time_filter(hot, boundary))))
