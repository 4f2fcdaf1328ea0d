"""The data model: labelled samples with tags promoted to columns, and the schemas of the tables around them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_LABEL = "__name__"
#: Length of a storage partition in milliseconds.
PARTITION_MS = 1_800_000

LABELS = T.MapType(T.StringType(), T.StringType())
SAMPLES_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("tags", LABELS),
        T.StructField("t", T.LongType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)
TOMBSTONES_SCHEMA = T.StructType([T.StructField("series_id", T.LongType()), T.StructField("min_t", T.LongType()), T.StructField("max_t", T.LongType())])


@dataclass(frozen=True)
class Samples:
    """A table of samples: columns metric, t (ms), v, seq (ingest order), and the tags.

    ``promoted`` maps a tag's name to the column that holds it; such tags are pruned, pushed down and grouped by as
    columns. ``numeric`` names promoted tags whose column is a BIGINT, compared as one where a matcher's value is a
    canonical integer. Tags beyond those are in the map column ``tags_column``, if there is one. ``time_column`` names
    the TIMESTAMP_NTZ column behind t, so that ranges reach the file scan. ``unique`` promises one sample for each
    series and t, so that no merge is needed.
    """

    df: DataFrame
    promoted: dict[str, str] = field(default_factory=dict)
    numeric: frozenset[str] = frozenset()
    tags_column: str | None = None
    time_column: str | None = None
    partition_column: str | None = None
    unique: bool = False

    def label(self, name: str) -> Column:
        """A label's value as a string, null where a series lacks it."""
        if name == METRIC_LABEL:
            return F.col("metric")
        if name in self.promoted:
            c = F.col(self.promoted[name])
            return c.cast("string") if name in self.numeric else c
        if self.tags_column:
            return F.col(self.tags_column)[name]
        return F.lit(None).cast("string")

    def series_key(self) -> list[str]:
        """The columns that identify a series."""
        return ["metric", *self.promoted.values(), *([self.tags_column] if self.tags_column else [])]

    def labels_map(self, with_metric: bool = False) -> Column:
        """All tags of a series as one map; absent tags have no entry."""
        own = [F.struct(F.lit(n).alias("key"), self.label(n).alias("value")) for n in sorted([*self.promoted, *([METRIC_LABEL] if with_metric else [])])]
        entries = F.filter(F.array(*own), lambda e: e["value"].isNotNull()) if own else None
        if self.tags_column:
            rest = F.coalesce(F.map_entries(self.tags_column), F.array().cast("array<struct<key:string,value:string>>"))
            entries = rest if entries is None else F.concat(entries, rest)
        if entries is None:
            return F.create_map().cast(LABELS)
        return F.map_from_entries(F.array_sort(entries))

    def with_df(self, df: DataFrame, **changes) -> Samples:
        return replace(self, df=df, **changes)


def empty_samples(spark: SparkSession) -> Samples:
    return Samples(spark.createDataFrame([], SAMPLES_SCHEMA), tags_column="tags")
