"""Selection: a closed time range and a conjunction of matchers, merged newest first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import DAY_MS, div
from ..model import PARTITION_MS, Samples
from .matchers import Matcher, conjunction

MOST = (1 << 63) - 1
#: Timestamps beyond this (in ms) have no TIMESTAMP of their own.
LAST_TIMESTAMP = 253_402_300_799_999


def time_filter(samples: Samples, mint: int, maxt: int = MOST) -> DataFrame:
    """Rows with t in [max(mint, 0), maxt].

    The bounds are also put on the column behind t and on the partition column, where there are any, so that files,
    row groups and partitions outside are not read: filters on a derived t don't reach the scan.
    """
    mint = max(mint, 0)
    df = samples.df
    if samples.time_column:
        ts = F.col(samples.time_column)
        df = df.filter(ts >= F.timestamp_millis(F.lit(min(mint, LAST_TIMESTAMP))).cast("timestamp_ntz"))
        if maxt < LAST_TIMESTAMP:
            df = df.filter(ts < F.timestamp_millis(F.lit(max(maxt + 1, 0))).cast("timestamp_ntz"))
        if mint <= maxt and mint <= LAST_TIMESTAMP:
            return df
    elif samples.partition_column:
        bounds = {samples.partition_column: PARTITION_MS, **({"day": DAY_MS} if "day" in df.columns else {})}  # day: the store's directories
        for c, length in bounds.items():
            df = df.filter(F.col(c) >= mint // length)
            if maxt < LAST_TIMESTAMP:
                df = df.filter(F.col(c) <= max(maxt, 0) // length)
    return df.filter((F.col("t") >= mint) & (F.col("t") <= maxt))


def select(samples: Samples, matchers: Iterable[Matcher], mint: int = 0, maxt: int = MOST, dedupe: bool = True, tree_mode: bool = False) -> Samples:
    """The samples of all matching series in a closed range.

    With ``dedupe`` each series has one sample for a timestamp, the one ingested last; without, all are kept.
    """
    found = samples.with_df(time_filter(samples, mint, maxt).filter(conjunction(matchers, samples, tree_mode)))
    return merge_newest(found) if dedupe else found


def merge_newest(samples: Samples, slice_ms: int | None = None) -> Samples:
    """One sample for each series and timestamp: that of the greatest seq.

    With ``slice_ms`` rows are first dealt by series and time slice (column ``slice``), which later aggregations over
    buckets within a slice can go on with, so that merging and aggregating take one shuffle, and a series with many
    samples is dealt to many tasks.
    """
    keys = samples.series_key()
    if samples.unique:
        return samples
    df = samples.df
    if slice_ms:
        keys = [*keys, "slice"]
        df = df.withColumn("slice", div(F.col("t"), slice_ms)).repartition(*keys)
    merged = df.groupBy(*keys, "t").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
    return samples.with_df(merged, time_column=None, partition_column=None, unique=True)


def concat(first: Samples, *others: Samples) -> Samples:
    """Several sources one behind another, nothing merged; tags are lined up by name."""
    df = first.df.select(*first.series_key(), "t", "v", "seq")
    for o in others:
        if o.promoted.keys() != first.promoted.keys() or bool(o.tags_column) != bool(first.tags_column):
            raise ValueError("the sources promote different tags")
        names = [F.col(o.promoted[n]).alias(c) for n, c in first.promoted.items()]
        if first.tags_column:
            names.append(F.col(o.tags_column).alias(first.tags_column))
        df = df.unionByName(o.df.select("metric", *names, "t", "v", "seq"))
    return first.with_df(df, time_column=None, partition_column=None, unique=False)


def merge_sources(first: Samples, *others: Samples) -> Samples:
    """Several sources (tiers, blocks, slices) that may overlap, the newest sample kept."""
    return merge_newest(concat(first, *others))


def seek(samples: Samples, t: int) -> Samples:
    """Samples at or after t."""
    return samples.with_df(time_filter(samples, t))


def first_at_or_after(samples: Samples, t: int) -> DataFrame:
    """For each series its first sample at or after t."""
    return time_filter(samples, t).groupBy(*samples.series_key()).agg(F.min("t").alias("t"), F.min_by("v", "t").alias("v"))


def as_of(samples: Samples, t: int) -> DataFrame:
    """For each series its last sample at or before t."""
    return time_filter(samples, 0, t).groupBy(*samples.series_key()).agg(F.max("t").alias("t"), F.max_by("v", "t").alias("v"))


def nested(samples: Samples, slice_ms: int = DAY_MS) -> DataFrame:
    """Rows for each series and time slice (column slice): labels and its samples in time order, so a long series is no single row."""
    points = F.array_sort(F.collect_list(F.struct("t", "v")))
    return samples.df.groupBy(*samples.series_key(), div(F.col("t"), slice_ms).alias("slice")).agg(points.alias("samples")).withColumn("labels", samples.labels_map(with_metric=True))


def unnested(series: DataFrame) -> DataFrame:
    """The rows of nested series again: (labels, t, v)."""
    return series.select("labels", F.explode("samples").alias("p")).select("labels", "p.t", "p.v")


def combine(left: Samples, right: Samples, on: list[str]) -> DataFrame:
    """Rows of two selections with the same values of some labels and the same t: series arithmetic."""
    a = left.df.select(*(left.label(n).alias(n) for n in on), "t", F.col("v").alias("left_v"))
    b = right.df.select(*(right.label(n).alias(n) for n in on), "t", F.col("v").alias("right_v"))
    return a.join(b, [*on, "t"])
