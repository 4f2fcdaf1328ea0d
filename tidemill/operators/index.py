"""The inverted index as plans over the series table: label metadata, postings and set operations on ids."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import METRIC_LABEL, Samples
from .matchers import Matcher
from .ranks import ranked_by_digest, ranked_in_order


def distinct_series(samples: Samples) -> DataFrame:
    """Each series once; grouping also takes tags in a map, which distinct() doesn't."""
    return samples.df.groupBy(*samples.series_key()).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def source_key(samples: Samples) -> Column:
    """A series' tags in one canonical text, by which ids are dealt."""
    return F.to_json(F.array_sort(F.map_entries(samples.labels_map())))


def series_table(samples: Samples) -> DataFrame:
    """Rows (series_id, source_id, metric_id, series columns): ids from 1, without gaps.

    Metrics, of which there are few, are numbered by name, sources by the digest of their tags and series by that and the
    metric, so a source keeps its id across its metrics. Sources and series are numbered in many tasks.
    """
    s = distinct_series(samples).withColumn("_source", source_key(samples))
    metrics = s.select("metric").distinct().withColumn("metric_id", F.row_number().over(Window.orderBy("metric")).cast("int"))
    sources = ranked_by_digest(s.select("_source").distinct(), "source_id", F.col("_source"))
    ranked = ranked_by_digest(s.join(sources, "_source").join(metrics, "metric"), "series_id", F.col("_source"), after=["metric"])
    return ranked.select(*samples.series_key(), "metric_id", "source_id", "series_id")


def _comparable(samples: Samples, c: str) -> Column:
    return F.array_sort(F.map_entries(c)) if c == samples.tags_column else F.col(c)


def with_ids(samples: Samples, series: DataFrame) -> DataFrame:
    """Samples with the ids of their series, matched by the whole label set; tags may be absent on both sides."""
    keys = samples.series_key()
    s = series.select("series_id", "source_id", "metric_id", *(_comparable(samples, k).alias(f"_{k}") for k in keys))
    cond = reduce(lambda a, b: a & b, (_comparable(samples, k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return samples.df.join(s, cond).drop(*(f"_{k}" for k in keys))


def _pairs(samples: Samples, df: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Rows (extra, name, value) of all labels of the series in df."""
    names = [METRIC_LABEL, *samples.promoted]
    own = F.array(*(F.struct(F.lit(n).alias("name"), samples.label(n).alias("value")) for n in names))
    if samples.tags_column:
        own = F.concat(own, F.transform(F.map_entries(samples.tags_column), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
    return df.select(*extra, F.explode(own).alias("l")).select(*extra, "l.name", "l.value").filter("value IS NOT NULL")


def label_names(samples: Samples) -> DataFrame:
    """Distinct names, ascending."""
    return _pairs(samples, distinct_series(samples)).select("name").distinct().orderBy("name")


def label_values(samples: Samples, name: str) -> DataFrame:
    """Distinct values of one label, ascending; series without it count for nothing."""
    return samples.df.select(samples.label(name).alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")


def symbols(samples: Samples) -> DataFrame:
    """All distinct strings in names and values."""
    p = _pairs(samples, distinct_series(samples))
    return p.select(F.explode(F.array("name", "value")).alias("symbol")).distinct()


def all_postings(series: DataFrame) -> DataFrame:
    return series.select("series_id")


def postings(samples: Samples, series: DataFrame, name: str, value: str) -> DataFrame:
    """Ids of series with a label's value."""
    return series.filter(samples.label(name) == value).select("series_id")


#: Ids of one label that are in one list.
PART = 65_536


def postings_index(samples: Samples, series: DataFrame) -> DataFrame:
    """The whole index: rows (name, value, part, ids), ids ascending; part is the range of PART ids that the list is of."""
    pairs = _pairs(samples, series, ["series_id"]).withColumn("part", F.expr(f"series_id div {PART}"))
    return pairs.groupBy("name", "value", "part").agg(F.sort_array(F.collect_list("series_id")).alias("ids"))


def add_postings(postings: DataFrame, samples: Samples, series: DataFrame) -> DataFrame:
    """The index with further series; those that are there already change nothing."""
    both = postings.unionByName(postings_index(samples, series))
    return both.groupBy("name", "value", "part").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def remove_postings(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without some series (column series_id); labels without series go."""
    gone = ids.groupBy(F.expr(f"series_id div {PART}").alias("part")).agg(F.collect_set("series_id").alias("_gone"))
    left = postings.join(gone, "part", "left").withColumn("ids", F.when(F.col("_gone").isNull(), F.col("ids")).otherwise(F.array_except("ids", "_gone")))
    return left.filter(F.size("ids") > 0).select("name", "value", "part", "ids")


def drop_label(postings: DataFrame, name: str, value: str) -> DataFrame:
    """The index without the list of one label."""
    return postings.filter((F.col("name") != name) | (F.col("value") != value))


def postings_counts(samples: Samples, series: DataFrame) -> DataFrame:
    return _pairs(samples, series, ["series_id"]).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def coldest(counts: DataFrame, share: float) -> DataFrame:
    """The share of labels with the fewest postings, those to move to the cold index; ties in the order of their digests."""
    ranked = ranked_by_digest(counts, "_rank", F.concat_ws("=", "name", "value"), ["n"], ["name"])
    total = counts.groupBy().agg(F.count(F.lit(1)).alias("_all"))
    return ranked.crossJoin(F.broadcast(total)).filter(F.col("_rank") <= F.floor(F.col("_all") * share)).drop("_rank", "_all")


def series_for(samples: Samples, series: DataFrame, matchers: Iterable[Matcher]) -> DataFrame:
    """Ids of series that all matchers select; none select nothing."""
    preds = [m.predicate(samples) for m in matchers]
    return series.filter(reduce(lambda a, b: a & b, preds) if preds else F.lit(False)).select("series_id")


def without_label(samples: Samples, series: DataFrame, name: str, keep: Column) -> DataFrame:
    """All series less those whose value does not match: the set form of a matcher that matches the empty string."""
    value = samples.label(name)
    return except_ids(all_postings(series), series.filter(value.isNotNull() & ~keep).select("series_id"))


def union_ids(*ids: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, ids).distinct()


def intersect_ids(*ids: DataFrame) -> DataFrame:
    """Ids in all of several lists, in one shuffle however many there are."""
    tagged = reduce(DataFrame.union, (d.select("series_id", F.lit(i).alias("i")) for i, d in enumerate(ids))).distinct()
    return tagged.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(ids)).select("series_id")


def except_ids(full: DataFrame, drop: DataFrame) -> DataFrame:
    return full.join(drop, "series_id", "left_anti")


def sorted_by_labels(samples: Samples, series: DataFrame) -> DataFrame:
    """Series with their rank in the order of label sets: name and value pairwise, then length."""
    return ranked_in_order(series, "rank", F.array_sort(F.map_entries(samples.labels_map(with_metric=True))))


def values_between(samples: Samples, name: str, lo: str, hi: str) -> DataFrame:
    """Distinct values of a label from lo to hi, both included, in the order of strings."""
    return label_values(samples, name).filter(F.col("value").between(lo, hi)).orderBy("value")


def values_with_prefix(samples: Samples, name: str, prefix: str) -> DataFrame:
    return label_values(samples, name).filter(F.col("value").startswith(prefix)).orderBy("value")


def save_series(series: DataFrame, path: str) -> None:
    """A snapshot of the series table, from which the index is rebuilt."""
    series.write.mode("overwrite").parquet(path)


def load_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
