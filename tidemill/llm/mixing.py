"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import mapped, sized_join, skew_join, width, written

WEIGHTS, MOST_COPIES, GROUP_ROWS, FANOUT, SEED = (5, 2, 1), 3, 1_000, 64, 11
ROW = "doc_id long, row long, times long, size long, source_size long, target double, sid int, bucket long, h long, whole int, sure long, x double"
#: Copies of a row that one task lists.
LISTED = 100_000


def n_words(text: Column) -> Column:
    """The number of runs of characters other than space and \\t to \\r; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Rows (sid, source, n_rows, source_size, target) from rows (source, size, times).

    Sources by code point, null last, weigh ``weights`` in turn and share all sizes; none gets over ``most`` times its
    own, and what it can't take is shared by the others by weight. With sources ordered by cap over weight, the level at
    which none is above its cap is the largest of (all - caps before) / (weights from here on). Sizes are summed before
    the shuffle; the windows run over one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("sid", sid.cast("int")).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    cap = F.col("source_size") * most
    order = Window.orderBy(cap / F.col("w"), "sid")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    s = s.withColumns({"caps": F.coalesce(F.sum(cap).over(before), zero), "ws": F.coalesce(F.sum("w").over(before), zero), "all": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    s = s.withColumn("level", F.max((F.col("all") - F.col("caps")) / (F.col("all_w") - F.col("ws"))).over(everything))
    return s.select("sid", "source", "n_rows", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("w")).alias("target"))


def _mixed(h: int, salt: int) -> float:
    """A number in [0, 1) that depends on both (splitmix64)."""
    z = (h + salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


class Pivot:
    """Meets the rows of one group one after another; ``rows`` gets (row number, x) once x is settled.

    Two fractions trade mass, weighted by size so that words are kept, until one is 0 or 1; which one gives is drawn so
    that each expectation stays. The one that stays fractional meets the next row.
    """

    def __init__(self, rows: list[tuple[int, float]]):
        self.rows, self.held = rows, None

    def meet(self, i: int, x: float, size: int, draw: float) -> None:
        if size == 0 or x <= 0 or x >= 1:
            self.rows.append((i, 0.0 if size == 0 else x))
            return
        if self.held is None:
            self.held = (i, x, size)
            return
        j, y, other = self.held
        up, down = min((1 - y) * other, x * size), min(y * other, (1 - x) * size)
        if draw * (up + down) < down:  # the held one takes
            full = (1 - y) * other <= x * size
            y, x = (1.0, max(0.0, x - up / size)) if full else (min(1.0, y + up / other), 0.0)
        else:
            full = y * other <= (1 - x) * size
            y, x = (0.0, min(1.0, x + down / size)) if full else (max(0.0, y - down / other), 1.0)
        self.held = None
        for k, v, s in ((j, y, other), (i, x, size)):
            if v in (0.0, 1.0) or self.held is not None:
                self.rows.append((k, v))
            else:
                self.held = (k, v, s)

    def end(self, last: bool) -> None:
        """The group's residual keeps its fraction, or goes to the nearer number where no further level follows."""
        if self.held is not None:
            i, x, _ = self.held
            self.rows.append((i, float(x >= 0.5) if last else x))
            self.held = None


def settle_group(xs: list[float], sizes: list[int], hashes: list[int], level: int, last: bool) -> list[float]:
    """The x of a group's rows after they met in their order; one at most stays fractional, none if this level is the last.

    On the last level the residual goes to the nearer number. The words that this gives or takes too many are made up
    for by rows that fit into the difference, the largest first, whose x was open and now goes to its other side.
    """
    rows: list[tuple[int, float]] = []
    pivot = Pivot(rows)
    for i, (x, size, h) in enumerate(zip(xs, sizes, hashes)):
        pivot.meet(i, x, size, _mixed(h, 1000 * level + i + 1 + SEED))
    residual = pivot.held
    pivot.end(last)
    out = [0.0] * len(xs)
    for i, x in rows:
        out[i] = x
    if last and residual is not None:
        at, x, size = residual
        over = (out[at] - x) * size
        side = 1.0 if over > 0 else 0.0
        for i in sorted((i for i, v in enumerate(xs) if i != at and 0 < v < 1 and out[i] == side and sizes[i]), key=lambda i: (-sizes[i], i)):
            if sizes[i] <= abs(over):
                out[i] = 1.0 - side
                over -= sizes[i] if over > 0 else -sizes[i]
    return out


def _settle(rows: DataFrame, last: bool, level: int, n: int) -> DataFrame:
    """One level of the tree: each (sid, bucket), about a group's rows, settles all its rows but one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on in the next batch
        key = None

        def out() -> pa.RecordBatch:
            g = pa.Table.from_batches(held).combine_chunks()
            x = settle_group(g["x"].to_pylist(), g["size"].to_pylist(), g["h"].to_pylist(), level, last)
            return g.set_column(g.schema.get_field_index("x"), "x", pa.array(x, pa.float64())).to_batches()[0]

        for b in batches:
            if not len(b):
                continue
            sid, bucket = (b.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "bucket"))
            cuts = [0, *(np.flatnonzero((sid[1:] != sid[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), len(b)]
            for at, end in zip(cuts, cuts[1:]):
                if held and (sid[at], bucket[at]) != key:
                    yield out()
                    held = []
                held.append(b.slice(at, end - at))
                key = (sid[at], bucket[at])
        if held:
            yield out()

    names = [c.split()[0] for c in ROW.split(", ")]
    dealt = rows.select(*names).repartition(n, "sid", "bucket").sortWithinPartitions("sid", "bucket", "h", "doc_id", "row")
    return mapped(dealt, run, ROW)


def _row() -> Column:
    """Tells rows of one id apart by text and source."""
    return F.xxhash64(F.lit(5), "text", "source")


def _settled(docs: DataFrame, weights: tuple[int, ...], most: int, group_rows: int) -> DataFrame:
    """Rows (doc_id, row, times, size, source_size, target, whole, extra): rows that are the same in all this, ``times`` of
    them, get ``whole`` copies each and ``extra`` of them one more."""
    spark = docs.sparkSession
    sizes = docs.select("doc_id", "source", _row().alias("row"), n_words(F.col("text")).alias("size"))
    sizes = written(sizes.groupBy("doc_id", "source", "row", "size").agg(F.count(F.lit(1)).alias("times")))
    targets = written(source_targets(sizes, weights, most))
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(p + 1e-12), F.lit(most)).cast("int")
    h = F.xxhash64(F.lit(SEED), "doc_id", "row", "size")
    named = lambda df: df.withColumns({"_s": F.coalesce("source", F.lit("")), "_null": F.col("source").isNull()}).drop("source")
    groups_of = F.ceil(F.col("n_rows") / group_rows)
    x = skew_join(named(sizes), named(targets).withColumns({"groups": groups_of}), ["_s", "_null"], "n_rows", sizes.count())
    open_ = F.greatest(F.lit(0.0), p - whole) * F.col("times")
    x = x.select("doc_id", "row", "times", "size", "source_size", "target", "sid", F.pmod(h, F.col("groups")).cast("long").alias("bucket"), h.alias("h"), whole.alias("whole"), F.floor(open_).alias("sure"), (open_ - F.floor(open_)).alias("x"))
    groups = targets.agg(F.max(groups_of)).head()[0] or 1
    done, level = None, 0
    while True:
        last = groups <= 1
        n = max(1, min(width(spark), groups * 64 if level else width(spark)))
        settled = written(_settle(x, last, level, n))
        kept = settled if last else settled.filter("x = 0 OR x = 1")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        x = settled.filter("x > 0 AND x < 1").withColumn("bucket", F.expr(f"bucket div {FANOUT}"))
        groups, level = -(-groups // FANOUT), level + 1
    return done.select("doc_id", "row", "times", "size", "source_size", "target", "whole", (F.col("sure") + F.col("x").cast("long")).alias("extra"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, row, size, source_size, target, copies), one for each row of documents; row tells rows of one id apart.

    A document of its source's share p = target / source_size gets floor(p) copies and one more with probability
    p - floor(p), by pivotal rounding: within groups of about ``group_rows`` documents of one source, picked by hash,
    then among the groups' residuals, FANOUT groups at a time, up to one residual for each source, which is rounded.
    So a source's words differ from its target by half a document at most, by a few words if it is one group, and a
    large source is many groups. Rows with one id, text and source meet as one, whose copies they share.
    Reruns agree, however rows are dealt. Null or blank texts have size 0 and no copies; a null source is a source.
    """
    found = _settled(docs, weights, most, group_rows)
    upto = lambda last: F.sequence(F.lit(0).cast("long"), last)
    few = found.filter(F.col("times") <= LISTED).select("*", F.explode(upto(F.col("times") - 1)).alias("i"))
    parts = found.filter(F.col("times") > LISTED).select("*", F.explode(upto(F.expr(f"(times - 1) div {LISTED}"))).alias("part")).repartition(width(docs.sparkSession))
    many = parts.select("*", F.explode(upto(F.least(F.lit(LISTED - 1).cast("long"), F.col("times") - 1 - F.col("part") * LISTED))).alias("j"))
    each = few.unionByName(many.withColumn("i", F.col("part") * LISTED + F.col("j")).drop("part", "j"))
    return each.select("doc_id", "row", "size", "source_size", "target", (F.col("whole") + (F.col("i") < F.col("extra")).cast("int")).alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents, each as often as the mix takes it; columns of any name stay as they are.

    Rows of one id, text and source are one row, taken as often as all of them. An empty table stays empty.
    """
    no_id = F.coalesce("doc_id", F.lit(-(2**63)))
    copies = written(
        _settled(docs, WEIGHTS, MOST_COPIES, GROUP_ROWS).groupBy(no_id.alias("_id"), F.col("row").alias("_row")).agg(F.sum(F.col("times") * F.col("whole") + F.col("extra")).alias("_copies"), F.sum("times").alias("_times"))
    )
    x = docs.select(F.struct("*").alias("_own"), no_id.alias("_id"), _row().alias("_row"))
    again = copies.filter("_times > 1").select("_id", "_row")
    out = x.join(copies.filter("_times = 1 AND _copies > 0"), ["_id", "_row"])
    if not again.isEmpty():
        apart = sized_join(x, again, ["_id", "_row"], F.monotonically_increasing_id(), "left_anti")
        one = sized_join(x, again, ["_id", "_row"], F.monotonically_increasing_id(), "left_semi").dropDuplicates(["_id", "_row"])
        out = apart.join(copies.filter("_times = 1 AND _copies > 0"), ["_id", "_row"]).unionByName(one.join(copies.filter("_times > 1 AND _copies > 0"), ["_id", "_row"]))
    last = lambda part: F.least(F.lit(LISTED).cast("long"), F.col("_copies") - part * LISTED)
    parts = out.select("_own", "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {LISTED}"))).alias("_part"))
    return parts.select("_own", F.explode(F.sequence(F.lit(1).cast("long"), last(F.col("_part")))).alias("_copy")).select("_own.*")
