"""Aggregation over time buckets and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import bucket
from ..model import Samples
from .select import merge_newest

AGGREGATES = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "count": F.count}
#: A slice holds this many buckets, so that one series spreads over tasks and its buckets stay whole.
BUCKETS_PER_SLICE = 256


def bucketed(samples: Samples, width: int, how: str, labels: list[str], out: str) -> DataFrame:
    """One aggregate for each combination of labels (and the metric) and time bucket.

    Samples are merged first (newest wins); both steps share one shuffle by series and time slice if the labels
    identify the series, else the aggregate is computed in part before its own.
    """
    merged = samples if samples.unique else merge_newest(samples, width * BUCKETS_PER_SLICE)
    keys = [merged.label(n).alias(n) for n in labels]
    whole = not samples.unique and {merged.promoted.get(n) for n in labels} >= set(merged.promoted.values()) and not merged.tags_column
    if whole:
        own = [*merged.series_key(), "slice"]
        x = merged.df.groupBy(*own, bucket(F.col("t"), width).alias("bucket_ms")).agg(AGGREGATES[how]("v").alias(out))
        return x.select("metric", *keys, "bucket_ms", out)
    return merged.df.groupBy("metric", *keys, bucket(F.col("t"), width).alias("bucket_ms")).agg(AGGREGATES[how]("v").alias(out))


def last_point(samples: Samples) -> DataFrame:
    """Each series' latest sample; of several at one time the newest."""
    at = F.struct("t", "seq")
    return samples.df.groupBy(*samples.series_key()).agg(F.max("t").alias("t"), F.max_by("v", at).alias("v"))


def grouped_by(samples: Samples, labels: list[str], aggregates: dict[str, Column]) -> DataFrame:
    return samples.df.groupBy(*(F.coalesce(samples.label(n), F.lit("")).alias(n) for n in labels)).agg(*(c.alias(n) for n, c in aggregates.items()))


def grouped_without(samples: Samples, labels: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Groups by all promoted tags but those named; the metric's name is dropped too."""
    return grouped_by(samples, [n for n in samples.promoted if n not in labels], aggregates)


def threshold(samples: Samples, above: float) -> DataFrame:
    """Samples above a value."""
    return samples.df.filter(F.col("v") > above)


def time_bounds(samples: Samples) -> DataFrame:
    return samples.df.groupBy().agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))


def deltas(samples: Samples) -> DataFrame:
    """Each sample's change of value and time since the one before it in its series; null for the first."""
    keys = [F.array_sort(F.map_entries(c)) if c == samples.tags_column else F.col(c) for c in samples.series_key()]
    w = Window.partitionBy(*keys).orderBy("t")
    return samples.df.withColumns({"dt": F.col("t") - F.lag("t").over(w), "dv": F.col("v") - F.lag("v").over(w)})


def rates(samples: Samples) -> DataFrame:
    """Change per second since the sample before; null for the first and where no time passed."""
    x = deltas(samples)
    return x.withColumn("rate", F.when(F.col("dt") > 0, F.col("dv") * 1000 / F.col("dt")))


def top_series(samples: Samples, n: int) -> DataFrame:
    """The n series with the greatest values, ties by series."""
    best = samples.df.groupBy(*samples.series_key()).agg(F.max("v").alias("max_v"))
    keys = [F.array_sort(F.map_entries(c)) if c == samples.tags_column else F.col(c) for c in samples.series_key()]
    return best.orderBy(F.desc("max_v"), *keys).limit(n)
