"""Time and id arithmetic as columns, and the driver-side range helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def div(a: Column, b: int | Column) -> Column:
    """Integer division towards zero."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return F.call_function("div", a, b)


def bucket(t: Column, width: int) -> Column:
    """The start of t's bucket."""
    return div(t, width) * width


def range_for_timestamp(t: Column, width: int) -> Column:
    """The end of the aligned range of ``width`` that holds t."""
    return div(t, width) * width + width


def floor_range(t: Column, width: int) -> Column:
    """The start of the aligned range that holds t, below zero too."""
    return t - F.pmod(t, F.lit(width).cast("long"))


def partition_of(t: Column, length: int) -> Column:
    return div(t, length)


def block_ranges(smallest: int, steps: int = 3, factor: int = 5) -> list[int]:
    """Block lengths of ``steps`` levels, each ``factor`` times the one before."""
    return [smallest * factor**i for i in range(steps)]


def chunk_end(first: int, last: int, limit: int) -> int:
    """Where a chunk a quarter full should end, so that chunks up to ``limit`` come out about equally long."""
    chunks = (limit - first) // (4 * (last - first + 1))
    return limit if chunks == 0 else first + (limit - first) // chunks


def chunk_end_of(first: Column, last: Column, limit: Column) -> Column:
    """``chunk_end`` of columns."""
    chunks = div(limit - first, (last - first + 1) * 4)
    return F.when(chunks == 0, limit).otherwise(first + div(limit - first, F.greatest(chunks, F.lit(1).cast("long")))).cast("long")


# The bits of packed ids.
CHUNK_BITS, METRIC_BITS, SERIES_BITS = 24, 9, 40


def _within(x: Column, bits: int, what: str) -> Column:
    """x as a BIGINT; a value that has more bits would run into its neighbour and fails the job."""
    x = x.cast("long")
    fits = (x >= 0) & (x < F.lit(1 << bits))
    return F.when(fits | x.isNull(), x).otherwise(F.raise_error(F.concat(F.lit(f"{what} beyond {bits} bits: "), x.cast("string"))).cast("long"))


def pack_chunk_id(series: Column, chunk: Column) -> Column:
    return F.shiftleft(_within(series, SERIES_BITS, "series id"), CHUNK_BITS).bitwiseOR(_within(chunk, CHUNK_BITS, "chunk id"))


def unpack_chunk_id(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, CHUNK_BITS), packed.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))


def pack_series_id(source: Column, metric: Column) -> Column:
    return F.shiftleft(_within(source, 63 - METRIC_BITS, "source id"), METRIC_BITS).bitwiseOR(_within(metric, METRIC_BITS, "metric id"))


def unpack_series_id(packed: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(packed, METRIC_BITS), packed.bitwiseAND(F.lit((1 << METRIC_BITS) - 1))


def clamp(lo: Column, hi: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """An interval cut to the bounds of what there is."""
    return F.greatest(lo, least), F.least(hi, most)


def overlaps(a_min: Column, a_max: Column, b_min: Column | int, b_max: Column | int) -> Column:
    """Whether two closed intervals share a point."""
    return (a_min <= b_max) & (a_max >= b_min)


def in_bounds(t: Column, lo: Column | int, hi: Column | int) -> Column:
    return (t >= lo) & (t <= hi)


def is_subrange(lo: Column, hi: Column, intervals: Column) -> Column:
    """Whether one of an array of structs (min_t, max_t) covers the whole interval."""
    return F.exists(intervals, lambda i: (i["min_t"] <= lo) & (i["max_t"] >= hi))
