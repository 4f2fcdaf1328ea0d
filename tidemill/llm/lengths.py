"""Token counts: an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import tokenized

RANGE = 128


def encoded_lengths(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int | None = None) -> DataFrame:
    """Rows (key, n_tokens) of all whole texts; a null text has none."""
    return tokenized(df, path, key, text, end_id).select(key, F.expr("octet_length(ids) div 2").alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Rows (n_tokens, n_docs), summed before the shuffle: a hot length is one row of each task. Null lengths count as 0."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: documents and tokens beyond it and up to it, and what truncation keeps.

    docs_at_least and tokens_at_least sum over this length and longer ones, docs_at_most over this and shorter ones;
    truncated_total is the sum of min(length, n_tokens) over all documents, total_docs and total_tokens are the corpus'.
    Sums run within ranges of RANGE lengths, and over the ranges' totals, of which there are as many as the longest
    length has ranges. An empty histogram gives no rows.
    """
    r = F.expr(f"n_tokens div {RANGE}").alias("r")
    each = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n"), r)
    after = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    ranges = (
        each.groupBy("r")
        .agg(F.sum("n_docs").alias("d"), F.sum("n").alias("t"))
        .select("r", F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    )
    here = Window.partitionBy("r").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    x = each.withColumns({"d": F.sum("n_docs").over(here), "t": F.sum("n").over(here)}).join(ranges, "r")
    docs, tokens = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return x.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("total_docs") - docs + F.col("n_docs")).alias("docs_at_most"),
        (F.col("total_tokens") - tokens + F.col("n_tokens") * docs).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def _first_at_least(sums: DataFrame, c: Column) -> DataFrame:
    return sums.groupBy().agg(F.min(F.when(c, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("x"), F.max("total_docs").alias("docs"), F.max("total_tokens").alias("tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: what truncation to any limit keeps, from the first length beyond it."""
    x = _first_at_least(sums, F.col("n_tokens") > limit)
    zero = F.lit(0)
    kept = F.col("tokens") - F.coalesce("x.tokens_at_least", zero) + F.lit(limit) * F.coalesce("x.docs_at_least", zero)
    return x.select(F.lit(limit).cast("long").alias("context"), F.coalesce(kept, zero).cast("long").alias("truncated_total"), F.coalesce("x.docs_at_least", zero).cast("long").alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents do not exceed (null: no documents)."""
    return _first_at_least(sums, F.col("docs_at_most") >= F.ceil(F.lit(q) * F.col("total_docs"))).select(F.lit(q).alias("q"), F.col("x.n_tokens").alias("n_tokens"))
