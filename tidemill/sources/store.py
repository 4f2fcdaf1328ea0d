"""The sample store: Parquet partitioned by time, sorted by series within files, and appends to it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_MS, div
from ..model import METRIC_LABEL, PARTITION_MS, SAMPLES_SCHEMA, Samples
from .shared import exists, file_at

#: Samples of a file; a day with more is several.
ROWS_A_FILE = 8_000_000
#: Storage partitions that a series has in one file, where its day is several.
PARTITIONS_TOGETHER = 12


class UnknownSeries(KeyError):
    """An append by an id that no series has."""


def _sortable(samples: Samples) -> list[Column]:
    return [F.to_json(F.array_sort(F.map_entries(c))) if c == samples.tags_column else F.col(c) for c in samples.series_key()]


def write_samples(samples: Samples, path: str, mode: str = "append", rows_a_file: int = ROWS_A_FILE) -> None:
    """Day directories with p, the 30-minute partition, as a column; rows sorted by series and time.

    Samples are counted by day, and a day is dealt to as many tasks as it has ``rows_a_file``, by its whole series key and
    a quarter of the day, so a hot series is in several files and row groups' statistics on metric, tags and p tell which to
    read. What reaches the driver is a count for each day.
    """
    df = samples.df.drop("p", "day", *([samples.time_column] if samples.time_column else []))
    df = df.withColumns({"p": div(F.col("t"), PARTITION_MS), "day": div(F.col("t"), DAY_MS)})
    files = {r[0]: -(-r[1] // rows_a_file) for r in df.groupBy("day").agg(F.count(F.lit(1))).collect()}
    if not files:
        df.limit(0).write.mode(mode).partitionBy("day").parquet(path)
        return
    own, more = _sortable(samples), {d: n for d, n in files.items() if n > 1}
    many = F.coalesce(F.create_map(*(F.lit(x).cast("long") for pair in more.items() for x in pair))[F.col("day")], F.lit(1)) if more else F.lit(1)
    dealt = df.repartition(sum(files.values()), "day", F.pmod(F.xxhash64(*own) + div(F.col("p"), PARTITIONS_TOGETHER), many))
    dealt.sortWithinPartitions("day", *own, "t").write.mode(mode).partitionBy("day").parquet(path)


def read_samples(spark: SparkSession, path: str, promoted: dict[str, str], numeric: frozenset[str] = frozenset(), tags_column: str | None = None) -> Samples:
    return Samples(spark.read.parquet(path), promoted, numeric, tags_column, partition_column="p")


def read_blocks(spark: SparkSession, paths: list[str], promoted: dict[str, str], numeric: frozenset[str] = frozenset(), tags_column: str | None = None) -> Samples:
    """Several stores as one; where they overlap, merging keeps what has the greater seq."""
    df = spark.read.parquet(paths[0])
    for p in paths[1:]:
        df = df.unionByName(spark.read.parquet(p))
    return Samples(df, promoted, numeric, tags_column, partition_column="p")


def greatest_seq(spark: SparkSession, path: str) -> int:
    """The greatest seq of a store, 0 if there is none; only that column is read."""
    if not exists(spark, path):
        return 0
    days = [x for x in _names(spark, path) if x.startswith("day=")]
    return (spark.read.parquet(path).agg(F.max("seq")).head()[0] or 0) if days else 0


def _names(spark: SparkSession, path: str) -> list[str]:
    p, files = file_at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(p)] if files.exists(p) else []


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the files under ``new`` in the place of those under ``path``, which go once the new ones are there."""
    (a, files), (b, _), (old, _) = (file_at(spark, x) for x in (new, path, f"{path}.old"))
    if files.exists(b) and not files.rename(b, old):
        raise OSError(f"{path} can't be moved")
    if not files.rename(a, b):
        files.rename(old, b)
        raise OSError(f"{new} can't be moved to {path}")
    files.delete(old, True)


def rewrite_without(samples: Samples, stones: DataFrame, path: str, by: str = "series_id") -> None:
    """Writes the samples (with their series' id) that no interval covers to ``path``, a new store of the usual layout."""
    from ..operators.tombstones import apply_tombstones

    if exists(samples.df.sparkSession, path):
        raise ValueError(f"{path} is there already; write beside it and replace it")
    write_samples(samples.with_df(apply_tombstones(samples.df, stones, by).drop(by)), path)


class Appender:
    """Buffers samples of one session on the driver and appends them as a whole.

    ``add`` makes a series known and returns its id, from 1 in order of first sight; ``add_fast`` takes an id and fails
    for one that no series has. Series survive a rollback, samples don't. What was committed outlives the session: the
    next one to open the store finds the series under their ids (in the directory ``_series``) and counts seq on from the
    store's greatest, so later samples are newer. One session writes at a time. Bulk ingest goes through ``append_table``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ids: dict[tuple, int] = {}
        self.labels: dict[int, dict[str, str]] = {}
        self.pending: list[tuple] = []
        if exists(spark, f"{path}/_series"):
            for i, labels in spark.read.parquet(f"{path}/_series").select("series_id", "labels").toLocalIterator():
                self.ids[tuple(sorted(labels.items()))], self.labels[i] = i, dict(labels)
        self.stored = max(self.labels, default=0)
        self.next_id = self.stored + 1
        self.seq = greatest_seq(spark, path)

    def add(self, labels: dict[str, str], t: int, v: float) -> int:
        key = tuple(sorted(labels.items()))
        if key not in self.ids:
            self.ids[key], self.labels[self.next_id] = self.next_id, dict(labels)
            self.next_id += 1
        self.add_fast(self.ids[key], t, v)
        return self.ids[key]

    def add_fast(self, series_id: int, t: int, v: float) -> None:
        if series_id not in self.labels:
            raise UnknownSeries(series_id)
        labels = self.labels[series_id]
        tags = {k: x for k, x in labels.items() if k != METRIC_LABEL}
        self.seq += 1
        self.pending.append((labels.get(METRIC_LABEL, ""), tags, int(t), float(v), self.seq))

    def insert(self, rows: Iterable[dict]) -> list[dict]:
        """Adds rows ``{"labels" or "id", "t", "v"}`` and commits those that are right; for each its id, or what is wrong with it."""
        out: list[dict] = []
        for r in rows:
            try:
                if "id" in r:
                    self.add_fast(r["id"], r["t"], r["v"])
                    out.append({"id": r["id"]})
                else:
                    if not r["labels"]:
                        raise ValueError("no labels")
                    out.append({"id": self.add(r["labels"], r["t"], r["v"])})
            except UnknownSeries:
                out.append({"error": f"unknown series {r['id']}"})
            except (KeyError, TypeError, ValueError) as e:
                out.append({"error": f"{type(e).__name__}: {e}"})
        self.commit()
        return out

    def commit(self) -> int:
        """Writes new series, then what was added, in one job, whose output appears whole or not at all; returns the number of samples."""
        rows, self.pending = self.pending, []
        if rows:
            new = [(i, self.labels[i]) for i in range(self.stored + 1, self.next_id)]
            if new:
                self.spark.createDataFrame(new, "series_id long, labels map<string,string>").coalesce(1).write.mode("append").parquet(f"{self.path}/_series")
                self.stored = self.next_id - 1
            write_samples(Samples(self.spark.createDataFrame(rows, SAMPLES_SCHEMA), tags_column="tags"), self.path)
        return len(rows)

    def rollback(self) -> None:
        self.pending = []

    def recover(self, rows: Iterable[tuple]) -> int:
        """Replays logged (labels, t, v) and commits them, under the ids and behind the seq that the store has."""
        for labels, t, v in rows:
            self.add(labels, t, v)
        return self.commit()

    def series(self) -> DataFrame:
        rows = [(i, x.get(METRIC_LABEL, ""), {k: v for k, v in x.items() if k != METRIC_LABEL}) for i, x in self.labels.items()]
        return self.spark.createDataFrame(rows, "series_id long, metric string, tags map<string,string>")

    def samples(self) -> Samples:
        return read_samples(self.spark, self.path, {}, tags_column="tags")


def append_by_id(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Rows (series_id, t, v, seq) as samples; ids that no series has fail the job."""
    known = series.select("series_id", "metric", "tags")
    x = rows.join(known, "series_id", "left")
    checked = F.when(F.col("metric").isNull(), F.raise_error(F.concat(F.lit("unknown series "), F.col("series_id").cast("string")))).otherwise(F.col("metric"))
    return x.select(checked.alias("metric"), "tags", "t", "v", "seq")


def append_table(samples: Samples, path: str) -> None:
    """Bulk ingest of a table in one job; its samples are newer than all that the store has, in their own order of seq."""
    least = greatest_seq(samples.df.sparkSession, path)
    write_samples(samples.with_df(samples.df.withColumn("seq", F.col("seq") + F.lit(least + 1))), path)
