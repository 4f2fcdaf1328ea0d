"""Ranks of all rows of a table without a sort in one task: rows fall into ordered buckets, which are counted and numbered apart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS, CUTS = 3, 255


def _numbered(x: DataFrame, name: str, bucket: list[str], order: list[str]) -> DataFrame:
    """``name``: the number of rows in buckets before, and of those up to this one in its own. Only the buckets' counts are summed in one task."""
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return x.join(counts, bucket).withColumn(name, (F.col("_before") + place).cast("long")).drop("_before")


def ranked_by_digest(df: DataFrame, name: str, key: Column, lead: Iterable[str] = (), after: Iterable[str] = ()) -> DataFrame:
    """``name``: ranks from 1 in the order of ``lead``, of which there are few values, then of the MD5 of ``key``, the key and ``after``.

    Digests spread evenly, so their first digits make buckets of one size, in the digests' own order.
    """
    x = df.withColumns({"_key": key, "_digest": F.md5(key)}).withColumn("_bucket", F.substring("_digest", 1, DIGITS))
    return _numbered(x, name, [*lead, "_bucket"], ["_digest", "_key", *after]).drop("_key", "_digest", "_bucket")


def ranked_in_order(df: DataFrame, name: str, key: Column) -> DataFrame:
    """``name``: ranks from 1 in the order of ``key``, by buckets between CUTS keys of a sample."""
    x = df.withColumn("_key", key)
    sample = x.select(F.col("_key").alias("k")).orderBy(F.xxhash64(F.to_json(F.struct("_key")))).limit(CUTS)
    cuts = sample.agg(F.sort_array(F.collect_list("k")).alias("_cuts"))
    x = x.crossJoin(F.broadcast(cuts)).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")
    return _numbered(x, name, ["_bucket"], ["_key"]).drop("_key", "_bucket")
