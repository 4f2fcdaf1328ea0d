"""Line dedup: lines that many documents share stay only in the last of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import ascii_lower, skew_join, width, written

BLANKS = " \t\n\x0b\f\r"
NO_ID = -(2**63)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc: doc_id, where a null is one document before all others; row: tells rows of one doc_id apart."""
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.lit(3), "text").alias("row"), "text")


def line_hashes(docs: DataFrame, min_length: int) -> DataFrame:
    """Rows (doc, row, pos, h1, h2): 128 bits of the key of each line of at least min_length code points."""
    x = _numbered(docs)
    lines = x.select("doc", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_length)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def shared_lines(hashes: DataFrame, min_docs: int) -> DataFrame:
    """Rows (h1, h2, n, keeper) of keys in at least min_docs documents; n is the number of their lines, keeper the largest doc.

    Ranges of (hash, doc) deal the rows, so a hot line spreads over many partitions; each streams, in the order of
    hash, document and position, the first occurrence in each document. These are counted before they are shuffled by
    hash, which leaves a row for each hash and partition.
    """
    dealt = hashes.select("h1", "h2", "doc", "pos").repartitionByRange(width(hashes.sparkSession), "h1", "h2", "doc")
    order = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    first = dealt.withColumn("at", F.row_number().over(order)).groupBy("h1", "h2").agg(F.count(F.when(F.col("at") == 1, 1)).alias("docs"), F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper"))
    return first.filter(F.col("docs") >= min_docs).drop("docs")


def keep_bitmaps(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (doc, row, n_dropped, dropped, keep_bitmap) of documents that lose lines.

    dropped is an array of runs (at, n) of line positions, ascending; keep_bitmap is the same as bytes: the bitmap of
    the document's lines run by run, each run of dropped lines as two big-endian 32-bit integers.
    """
    hashes = written(line_hashes(docs, min_length))
    shared = written(shared_lines(hashes, min_docs))
    gone = skew_join(hashes, shared, ["h1", "h2"], "n", hashes.count()).filter("doc <> keeper").select("doc", "row", "pos")
    at = gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.expr("filter(p, (x, i) -> i = 0 OR x - p[i - 1] > 1)")
    ends = F.expr("filter(p, (x, i) -> i = size(p) - 1 OR p[i + 1] - x > 1)")
    runs = at.select("doc", "row", F.size("p").alias("n_dropped"), F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("at"), (e - s + 1).alias("n"))).alias("dropped"))
    eight = lambda c: F.lpad(F.hex(c), 8, "0")
    return runs.withColumn("keep_bitmap", F.unhex(F.array_join(F.transform("dropped", lambda r: F.concat(eight(r["at"]), eight(r["n"]))), "")))


def dedup_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept, keep_bitmap), one for each row of documents.

    A null or empty text is one empty line. Lines whose key has under min_length code points always stay. Rows of one
    doc_id count as one document, and so do all rows of a null one, which is smaller than any other; each row still
    has its own result. Where nothing is dropped keep_bitmap is null. Other columns aren't read.
    """
    found = keep_bitmaps(docs, min_length, min_docs)
    x = _numbered(docs).join(found, ["doc", "row"], "left")
    lines = _lines(F.col("text"))
    n = F.size(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda r: r["at"] + r["n"]))
    ends = F.concat(F.transform("dropped", lambda r: r["at"]), F.array(n))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s))), "\n")
    return x.select(
        "doc_id",
        n.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
        "keep_bitmap",
    )


def line_digests(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
