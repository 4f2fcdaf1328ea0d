"""Blocks on disk: a directory each, with its samples, its deleted ranges and a file of metadata, and their compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY_MS, HOUR_MS
from ..model import Samples
from ..operators.tombstones import apply_tombstones, read_tombstones, write_tombstones
from ..plans.blocks import DEFAULT_RANGES, chunk_metas, compacted_meta, plan
from .shared import exists, file_at
from .store import read_blocks as read_stores
from .store import write_samples

META = (
    "block_id string, min_t long, max_t long, level int, failed boolean, sources array<string>, parents array<string>,"
    " num_samples long, num_series long, num_chunks long, num_tombstones long, num_bytes long"
)
CHUNK_MS = 2 * HOUR_MS


def _size(spark: SparkSession, path: str) -> int:
    p, files = file_at(spark, path)
    return files.getContentSummary(p).getLength()


def _write_meta(spark: SparkSession, path: str, row: dict) -> None:
    names = [c.split()[0] for c in META.split(",")]
    df = spark.createDataFrame([tuple(row[n] for n in names)], META)
    df.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_block(samples: Samples, root: str, level: int = 1, sources: list[str] | None = None, parents: list[str] | None = None, bounds: tuple[int, int] | None = None) -> str:
    """Writes a block of samples under ``root``, its metadata last, so that a block without it is no block; returns its id.

    ``bounds`` (max exclusive) are the block's, else those of its samples. num_chunks counts each series' spans of CHUNK_MS.
    """
    spark, block = samples.df.sparkSession, uuid.uuid4().hex
    path = f"{root}/{block}"
    write_samples(samples, f"{path}/chunks")
    own = read_stores(spark, [f"{path}/chunks"], samples.promoted, samples.numeric, samples.tags_column)
    chunks = chunk_metas(own, CHUNK_MS)
    series = chunks.groupBy(*own.series_key()).agg(F.count(F.lit(1)).alias("c"), F.sum("num_samples").alias("n"), F.min("min_t").alias("lo"), F.max("max_t").alias("hi"))
    n, s, c, lo, hi = series.agg(F.sum("n"), F.count(F.lit(1)), F.sum("c"), F.min("lo"), F.max("hi")).head()
    lo, hi = bounds or (lo, None if hi is None else hi + 1)
    _write_meta(spark, path, {"block_id": block, "min_t": lo, "max_t": hi, "level": level, "failed": False, "sources": sources or [block], "parents": parents or [], "num_samples": n or 0, "num_series": s, "num_chunks": c or 0, "num_tombstones": 0, "num_bytes": _size(spark, f"{path}/chunks")})
    return block


def block_metas(spark: SparkSession, root: str) -> DataFrame:
    """The table of blocks under ``root``."""
    p, files = file_at(spark, root)
    there = [f"{x.getPath()}/meta" for x in files.listStatus(p) if exists(spark, f"{x.getPath()}/meta/_SUCCESS")] if files.exists(p) else []
    return spark.read.schema(META).json(there) if there else spark.createDataFrame([], META)


def block_samples(spark: SparkSession, root: str, ids: list[str], promoted: dict[str, str], numeric: frozenset[str] = frozenset(), tags_column: str | None = None, by: str | None = None) -> Samples:
    """The samples of some blocks, without those that their deleted ranges (by the column ``by``) cover."""
    own = [read_stores(spark, [f"{root}/{i}/chunks"], promoted, numeric, tags_column) for i in ids]
    out = []
    for i, x in zip(ids, own):
        stones = f"{root}/{i}/tombstones"
        df = x.df
        if by is not None and exists(spark, stones):
            df = apply_tombstones(df, read_tombstones(spark, stones).withColumnRenamed("series_id", by), by)
        out.append(df)
    df = out[0]
    for more in out[1:]:
        df = df.unionByName(more)
    return own[0].with_df(df)


def delete_from_block(spark: SparkSession, root: str, block: str, stones: DataFrame) -> None:
    """Adds deleted ranges (series_id, min_t, max_t) to a block's own, cut to its bounds, and counts them in its metadata."""
    path = f"{root}/{block}"
    meta = block_metas(spark, root).filter(F.col("block_id") == block).head().asDict()
    lo, hi = F.lit(meta["min_t"]), F.lit(meta["max_t"] - 1)
    new = stones.filter((F.col("min_t") <= hi) & (F.col("max_t") >= lo)).select("series_id", F.greatest("min_t", lo).alias("min_t"), F.least("max_t", hi).alias("max_t"))
    if exists(spark, f"{path}/tombstones"):
        new = new.unionByName(read_tombstones(spark, f"{path}/tombstones"))
    write_tombstones(new, f"{path}/tombstones.new")
    p, files = file_at(spark, f"{path}/tombstones")
    files.delete(p, True)
    files.rename(file_at(spark, f"{path}/tombstones.new")[0], p)
    _write_meta(spark, path, meta | {"num_tombstones": read_tombstones(spark, f"{path}/tombstones").count()})


def remove_block(spark: SparkSession, root: str, block: str) -> None:
    p, files = file_at(spark, f"{root}/{block}")
    files.delete(p, True)


def compact_next(spark: SparkSession, root: str, promoted: dict[str, str], numeric: frozenset[str] = frozenset(), tags_column: str | None = None, by: str | None = None, ranges: list[int] = DEFAULT_RANGES) -> str | None:
    """Compacts the blocks that the plan names into one, which is written whole before its parents go; returns its id, None if there is nothing to do.

    The newest of overlapping samples is kept, and deleted ranges are applied. If it fails, the parents stay as they are.
    """
    from ..operators.select import merge_newest

    metas = block_metas(spark, root)
    todo = plan(metas, ranges)
    rows = todo.orderBy("min_t", "max_t", "block_id").collect()  # a row for each block of one compaction
    if not rows:
        return None
    ids = [r["block_id"] for r in rows]
    meta = compacted_meta(todo).head()
    merged = merge_newest(block_samples(spark, root, ids, promoted, numeric, tags_column, by))
    block = write_block(merged, root, meta["level"], list(meta["sources"]), ids, (meta["min_t"], meta["max_t"]))
    for i in ids:
        remove_block(spark, root, i)
    return block


def clean_block(spark: SparkSession, root: str, block: str, promoted: dict[str, str], numeric: frozenset[str] = frozenset(), tags_column: str | None = None, by: str = "series_id") -> str:
    """Rewrites a block without its deleted samples, as a new block in its place; returns the id."""
    meta = block_metas(spark, root).filter(F.col("block_id") == block).head()
    new = write_block(block_samples(spark, root, [block], promoted, numeric, tags_column, by), root, meta["level"], list(meta["sources"]), [block], (meta["min_t"], meta["max_t"]))
    remove_block(spark, root, block)
    return new


def blocks_by_day(samples: Samples, root: str, days: int = 1) -> list[str]:
    """Writes samples as blocks of so many days each; the list of their starts reaches the driver."""
    width = days * DAY_MS
    starts = [r[0] for r in samples.df.select(F.expr(f"t div {width}").alias("b")).distinct().orderBy("b").collect()]
    return [write_block(samples.with_df(samples.df.filter((F.col("t") >= b * width) & (F.col("t") < (b + 1) * width))), root, bounds=(b * width, (b + 1) * width)) for b in starts]
