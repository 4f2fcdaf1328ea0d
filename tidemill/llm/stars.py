"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import checkpointed, mapped, salted_join, skew_join, written


#: With more edges than this, a node's neighbours can be more than 16 tasks should have.
SALTED_EDGES = 50_000_000


def _with_least(e: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges with the m of their u; those of a node with very many neighbours aren't shuffled. least has (u, m, c), c the edges of u."""
    if n <= SALTED_EDGES:
        return salted_join(e, least.drop("c"), ["u"], F.col("v"))
    return skew_join(e, checkpointed(least), ["u"], "c", n)


def _large(e: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbours and itself."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    return _with_least(both, least, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them; e has u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    moved = _with_least(e, least, n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head()
    return tuple(r)


NODES_HELD, EDGES_AT_ONCE = 300_000, 300_000


def forest(edges: DataFrame, held: int = 0) -> DataFrame:
    """Fewer edges (a, b), a less than b, with the same components: each task merges those it reads and passes on a star for each of its components.

    A task holds ``held`` (NODES_HELD) nodes at most; then it passes on what it has and starts anew.
    """
    held = held or NODES_HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def out() -> pa.RecordBatch:
            pairs = [(top(x), x) for x in up]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], names=["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.column("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(up.setdefault(a, a)), top(up.setdefault(b, b))
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > held:
                yield out()
                up = {}
        if up:
            yield out()

    return mapped(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"), run, edges.select("a", "b").schema)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) of all nodes of ``edges`` (columns a, b of one type); root is the least node of the component.

    Edges that are counted to be no more than EDGES_AT_ONCE are merged by one task, which holds no more nodes than twice
    that; more are merged task by task and go through rounds of stars, each cut off by a checkpoint, in which minima are
    taken before the shuffle and the rows of a node with many neighbours are joined in several tasks. Edges of a node with
    itself, and null ends, are left out.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(e)
    n = e.count()
    if n == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if n <= EDGES_AT_ONCE:
        e = written(forest(e.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1), 2 * EDGES_AT_ONCE).select(F.col("b").alias("u"), F.col("a").alias("v")))
        return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    e = written(forest(e.select(F.col("u").alias("a"), F.col("v").alias("b")))).select(F.col("b").alias("u"), F.col("a").alias("v"))
    e, mark = checkpointed(e.distinct()), None
    for _ in range(most_rounds):
        e = _large(e, n)
        e = checkpointed(_small(e if n <= SALTED_EDGES else checkpointed(e), n))
        now = _mark(e)
        n = now[0]
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
