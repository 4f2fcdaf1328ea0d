"""Blocks: time slices with metadata, and what to compact, expire and report, planned over the table of blocks.

A block has the rows (block_id, min_t, max_t) with max_t exclusive, and optionally level, failed, num_series and
num_tombstones. The table of blocks is small, so windows over all of it are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import block_ranges, floor_range, overlaps
from ..model import Samples
from ..operators.select import merge_sources, time_filter
from ..operators.tombstones import apply_tombstones

DEFAULT_RANGES = block_ranges(2 * 3_600_000)
DEFAULT_RETENTION_MS = 15 * 86_400_000
TOMBSTONE_SHARE = 0.05
ORDER = ("min_t", "max_t", "block_id")


def split_by_range(blocks: DataFrame, length: int) -> DataFrame:
    """Blocks that fit whole into an aligned range of ``length``, with the range's start as group."""
    start = floor_range(F.col("min_t"), length)
    return blocks.withColumn("group_start", start).filter(F.col("max_t") <= F.col("group_start") + length)


def _islands(blocks: DataFrame) -> DataFrame:
    """island: runs of blocks that begin before the end of one before them; reach: the latest end so far."""
    before = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    x = blocks.withColumn("_new", F.coalesce((F.col("min_t") >= F.max("max_t").over(before)).cast("int"), F.lit(1)))
    return x.withColumns({"island": F.sum("_new").over(upto), "reach": F.max("max_t").over(upto)}).drop("_new")


def overlapping_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in groups that overlap, with each group's bounds (group_min, group_max)."""
    whole = Window.partitionBy("island")
    x = _islands(blocks).withColumns({"_n": F.count(F.lit(1)).over(whole), "group_min": F.min("min_t").over(whole), "group_max": F.max("reach").over(whole)})
    return x.filter("_n > 1").drop("_n", "reach")


def overlapping_dirs(blocks: DataFrame) -> DataFrame:
    """The first group of overlapping blocks."""
    x = overlapping_blocks(blocks)
    first = x.groupBy().agg(F.min("island").alias("_first"))
    return x.join(F.broadcast(first), F.col("island") == F.col("_first")).drop("_first", "island", "group_min", "group_max")


def select_dirs(blocks: DataFrame, ranges: list[int]) -> DataFrame:
    """The first group of several blocks, by level and time, that fills its range or ends before the newest block begins.

    Groups with a block whose compaction failed are left alone.
    """
    newest = blocks.groupBy().agg(F.max_by("min_t", F.struct(*ORDER)).alias("_high"))
    found = None
    for level, length in enumerate(ranges[1:], 1):
        part = split_by_range(blocks, length).withColumns({"_level": F.lit(level), "_length": F.lit(length).cast("long")})
        found = part if found is None else found.unionByName(part)
    if found is None:
        return blocks.limit(0)
    failed = F.max(F.coalesce(F.col("failed"), F.lit(False))) if "failed" in blocks.columns else F.lit(False)
    groups = found.groupBy("_level", "_length", "group_start").agg(F.count(F.lit(1)).alias("_n"), F.min("min_t").alias("_lo"), F.max_by("max_t", F.struct(*ORDER)).alias("_hi"), failed.alias("_failed"))
    fits = (F.col("_hi") - F.col("_lo") == F.col("_length")) | (F.col("_hi") <= F.col("_high"))
    best = groups.join(F.broadcast(newest)).filter((F.col("_n") > 1) & ~F.col("_failed") & fits).groupBy().agg(F.min(F.struct("_level", "group_start")).alias("_best"))
    x = found.join(F.broadcast(best), (F.col("_level") == F.col("_best._level")) & (F.col("group_start") == F.col("_best.group_start")))
    return x.select(*blocks.columns)


def many_tombstones(blocks: DataFrame, ranges: list[int]) -> DataFrame:
    """The newest block with too many tombstones for its series, among the long blocks behind which no short one comes."""
    long_enough = F.col("max_t") - F.col("min_t") >= ranges[len(ranges) // 2]
    newer = Window.orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    x = blocks.withColumn("_all", F.min(long_enough.cast("int")).over(newer))
    x = x.filter((F.col("_all") == 1) & (F.col("num_tombstones") > TOMBSTONE_SHARE * F.col("num_series")))
    return x.orderBy(*(F.desc(c) for c in ORDER)).limit(1).drop("_all")


def plan(blocks: DataFrame, ranges: list[int] = DEFAULT_RANGES) -> DataFrame:
    """Blocks to compact next: overlapping ones, else a group by range without the newest block, else one for its tombstones."""
    first = overlapping_dirs(blocks)
    rank = F.row_number().over(Window.orderBy(*(F.desc(c) for c in ORDER)))
    rest = blocks.withColumn("_r", rank).filter("_r > 1").drop("_r")
    options = [first, select_dirs(rest, ranges)]
    if {"num_series", "num_tombstones"} <= set(blocks.columns):
        options.append(many_tombstones(rest, ranges))
    x = reduce(DataFrame.unionByName, (o.select(*blocks.columns).withColumn("_step", F.lit(i)) for i, o in enumerate(options)))
    w = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumn("_first", F.min("_step").over(w)).filter("_step = _first").drop("_step", "_first")


def compacted_meta(blocks: DataFrame) -> DataFrame:
    """The one row of metadata of the block that ``blocks`` become."""
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))) if "sources" in blocks.columns else F.array_sort(F.collect_set("block_id"))
    level = F.max("level") if "level" in blocks.columns else F.lit(1)
    parents = F.array_sort(F.collect_list(F.struct("min_t", "max_t", "block_id")))
    return blocks.groupBy().agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t"), (level + 1).alias("level"), sources.alias("sources"), parents.alias("parents"))


def compact(sources: list[Samples], stones: DataFrame | None = None) -> Samples:
    """The samples of several blocks in one: newest first where they overlap, deleted ranges applied.

    stones: rows (the series' columns, min_t, max_t) need a series_id column on the samples.
    """
    merged = merge_sources(*sources)
    if stones is not None:
        merged = merged.with_df(apply_tombstones(merged.df, stones))
    return merged


def block_stats(samples: Samples, width: int, chunk: int | None = None, stones: DataFrame | None = None) -> DataFrame:
    """For each time slice: bounds and numbers of samples, series and chunks (of length ``chunk``, else one a series), and of tombstones (min_t, max_t) that touch it."""
    block = floor_range(F.col("t"), width)
    cut = floor_range(F.col("t"), chunk) if chunk else F.lit(0)
    each = samples.df.groupBy(block.alias("block_id"), *samples.series_key(), cut.alias("_chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    per_series = each.groupBy("block_id", *samples.series_key()).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = per_series.groupBy("block_id").agg(F.min("lo").alias("min_t"), F.max("hi").alias("max_t"), F.sum("n").alias("num_samples"), F.count(F.lit(1)).alias("num_series"), F.sum("c").alias("num_chunks"))
    if stones is None:
        return out
    touched = F.explode(F.sequence(floor_range(F.col("min_t"), width), floor_range(F.col("max_t"), width), F.lit(width).cast("long")))
    n = stones.select(touched.alias("block_id")).groupBy("block_id").agg(F.count(F.lit(1)).alias("num_tombstones"))
    return out.join(n, "block_id", "left").withColumn("num_tombstones", F.coalesce("num_tombstones", F.lit(0)))


def chunk_metas(samples: Samples, width: int) -> DataFrame:
    """Each series' chunks, one for each time slice: bounds and number of samples, in order of their start."""
    start = floor_range(F.col("t"), width)
    return samples.df.groupBy(*samples.series_key(), start.alias("chunk")).agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.count(F.lit(1)).alias("num_samples"))


def chunks_in_range(chunks: DataFrame, mint: int, maxt: int) -> DataFrame:
    """Chunks that share a point with a closed range."""
    return chunks.filter(overlaps(F.col("min_t"), F.col("max_t"), F.lit(max(mint, 0)), F.lit(maxt)))


def retain(samples: Samples, mint: int) -> Samples:
    """Retention: samples from mint on; the bound reaches the files."""
    return samples.with_df(time_filter(samples, mint))


def retain_by_age(samples: Samples, age_ms: int = DEFAULT_RETENTION_MS) -> Samples:
    """Retention by age against the newest sample, which is looked up first, so that the bound reaches the files."""
    newest = samples.df.agg(F.max("t")).head()[0]
    return samples if newest is None else retain(samples, newest - age_ms)


def retain_by_size(blocks: DataFrame, most: int, size: str = "num_bytes") -> DataFrame:
    """The newest blocks whose sizes together stay within ``most``."""
    newer = Window.orderBy(*(F.desc(c) for c in ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_sum", F.sum(size).over(newer)).filter(F.col("_sum") <= most).drop("_sum")


def checkpoint(samples: Samples, series: DataFrame, mint: int) -> Samples:
    """What a checkpoint at mint writes: samples from mint on, of the series to keep alone (rows of the series' columns; tags in a map aren't compared)."""
    keys = [k for k in samples.series_key() if k != samples.tags_column]
    return samples.with_df(retain(samples, mint).df.join(series.select(*keys).distinct(), keys, "left_semi"))


def checkpoint_stats(samples: Samples, mint: int, stones: DataFrame | None = None) -> DataFrame:
    """What a checkpoint at mint sees and drops: samples before it, and tombstones that end before it."""
    out = samples.df.groupBy().agg(F.count(F.lit(1)).alias("total_samples"), F.count(F.when(F.col("t") < mint, 1)).alias("dropped_samples"))
    if stones is not None:
        t = stones.groupBy().agg(F.count(F.lit(1)).alias("total_tombstones"), F.count(F.when(F.col("max_t") < mint, 1)).alias("dropped_tombstones"))
        out = out.join(F.broadcast(t))
    return out
