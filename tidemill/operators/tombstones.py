"""Deleted ranges: closed intervals of time for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import clamp, div, overlaps
from ..model import TOMBSTONES_SCHEMA

#: Intervals are looked up by time cells of this length where they are joined with samples.
CELL_MS = 86_400_000
LONG = 400


def coalesce_intervals(stones: DataFrame, by: str = "series_id") -> DataFrame:
    """Overlapping and adjacent intervals (a gap of 1 ms) of each series as one. Intervals that end before they begin go."""
    order = Window.partitionBy(by).orderBy("min_t", "max_t")
    reach = F.max("max_t").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = stones.filter("min_t <= max_t").select(by, "min_t", "max_t").withColumn("_new", F.coalesce((F.col("min_t") > reach + 1).cast("int"), F.lit(1)))
    x = x.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "_island").agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t")).drop("_island")


def delete_range(series_bounds: DataFrame, mint: int, maxt: int) -> DataFrame:
    """Intervals of a deletion: for each row (series_id, first_t, last_t) the range cut to what the series has."""
    lo, hi = clamp(F.lit(mint).cast("long"), F.lit(maxt).cast("long"), F.col("first_t"), F.col("last_t"))
    hit = overlaps(F.col("first_t"), F.col("last_t"), F.lit(mint), F.lit(maxt))
    return series_bounds.filter(hit).select("series_id", lo.alias("min_t"), hi.alias("max_t"))


def apply_tombstones(samples: DataFrame, stones: DataFrame, by: str = "series_id") -> DataFrame:
    """Samples outside all intervals of their series.

    An interval is listed under the cells of time it touches, so the join has equal keys (series and cell), whatever
    the number of intervals. Those of more than LONG cells, of which a series can't have many as they don't overlap,
    are joined by series alone. Neither reads the samples more than once.
    """
    first, last = div(F.col("min_t"), CELL_MS), div(F.col("max_t"), CELL_MS)
    s = coalesce_intervals(stones, by).select(F.col(by).alias("_by"), F.col("min_t").alias("_min"), F.col("max_t").alias("_max"), first.alias("_a"), last.alias("_z"))
    short = s.filter(F.col("_z") - F.col("_a") <= LONG).withColumn("_cell", F.explode(F.sequence("_a", "_z")))
    own, inside = F.col(by) == F.col("_by"), F.col("t").between(F.col("_min"), F.col("_max"))
    left = samples.join(short, own & (div(F.col("t"), CELL_MS) == F.col("_cell")) & inside, "left_anti")
    return left.join(s.filter(F.col("_z") - F.col("_a") > LONG), own & inside, "left_anti")


def write_tombstones(stones: DataFrame, path: str) -> None:
    """Replaces the stored intervals by these, coalesced."""
    coalesce_intervals(stones).write.mode("overwrite").parquet(path)


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOMBSTONES_SCHEMA).parquet(path)


def covered_chunks(chunks: DataFrame, stones: DataFrame, by: str = "series_id") -> DataFrame:
    """Chunks (rows with min_t, max_t) that lie whole within one deleted interval of their series."""
    s = coalesce_intervals(stones, by).select(F.col(by).alias("_by"), F.col("min_t").alias("_lo"), F.col("max_t").alias("_hi"))
    return chunks.join(s, (F.col(by) == F.col("_by")) & (F.col("_lo") <= F.col("min_t")) & (F.col("max_t") <= F.col("_hi")), "left_semi")


def live_chunks(chunks: DataFrame, stones: DataFrame, by: str = "series_id") -> DataFrame:
    """Chunks that are left to read once those that are deleted whole are dropped."""
    s = coalesce_intervals(stones, by).select(F.col(by).alias("_by"), F.col("min_t").alias("_lo"), F.col("max_t").alias("_hi"))
    return chunks.join(s, (F.col(by) == F.col("_by")) & (F.col("_lo") <= F.col("min_t")) & (F.col("max_t") <= F.col("_hi")), "left_anti")
