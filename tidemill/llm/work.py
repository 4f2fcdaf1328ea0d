"""Reading tables, joins of skewed keys and Arrow helpers; intermediate tables go to the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import checkpointed, erase, kept, scratch, ship, shuffles_freed, swept, written, written_at


__all__ = ["ascii_lower", "checkpointed", "erase", "kept", "mapped", "salted_join", "scratch", "shuffles_freed", "sized_join", "skew_join", "swept", "table", "width", "written", "written_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The number of partitions to deal rows to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Returns free memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand; what a task has freed goes back to the system, as workers are reused."""
    ship(df.sparkSession)

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(handed, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Tables up to this many rows are broadcast.
MOST_BROADCAST = 100_000
#: A key with this share of all rows is hot, so that no more than one over it are; tables up to SMALL rows have none.
HOT_SHARE, SMALL = 1e-4, 1_000_000


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """A join in which the rows of one key of ``big`` go to ``salts`` tasks, by a hash of ``salt``, and those of ``small`` to each of them.

    Both are shuffled: ``small`` may grow with the data, and its copies are more than its size seems to be.
    """
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each.hint("merge"), [*on, "_salt"], how).drop("_salt")


def skew_join(big: DataFrame, small: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """An inner or left join in which hot keys of ``big`` are not shuffled.

    ``small`` has one row for each key, with the number of its rows in ``big`` (or a bound of it) in column n, which is
    dropped; ``total`` is the sum. At most 1 / HOT_SHARE keys can be hot, and these rows of ``small`` are broadcast; the
    rest is joined by a shuffle. Both are read twice, so they should be written, or cheap to make.
    """
    if total <= SMALL:
        return big.join(small.drop(n), on, how)
    least = max(1, int(total * HOT_SHARE))
    hot, cold = small.filter(F.col(n) > least).drop(n), small.filter(F.col(n) <= least).drop(n)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return big.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def sized_join(big: DataFrame, small: DataFrame, on: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """A join with ``small`` broadcast where it is counted to be no more than MOST_BROADCAST rows, else salted; ``small`` should be written."""
    if small.count() <= MOST_BROADCAST:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, salt, how)
