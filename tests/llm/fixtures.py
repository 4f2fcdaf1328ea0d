"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, columns with clashing names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away " * 4000
LINE = "this line is in many of the documents"
ROWS = [
    (1, f"{LINE}\nfirst", "en", "a", 1),
    (2, f"second\n  {LINE.upper()}\t\nshort\nshort", "en", "a", 1),
    (3, f"{LINE}\n{LINE}\nthird", "en", "b", 1),
    (3, f"{LINE}\n{LINE}\nthird", "en", "b", 1),
    (4, None, None, None, None),
    (5, "", "en", None, 0),
    (6, "\n\n", "fr", "c", 2),
    (7, "été à la plage, où ça ? 東京 😀", "fr", "c", 3),
    (8, LONG, "en", "a", len(LONG)),
    (9, "x" * 50_000, None, "b", 50_000),
    (None, f"no id\n{LINE}", "en", "b", 3),
    (10, "1234 5678 !!", "en", "a", 12),
]
#: Names that operators use for columns of their own.
CLASH = ["row", "doc", "media", "ids", "fp", "node", "score", "held_out", "_doc", "key", "k", "t", "x"]


def docs(spark, rows=None, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS if rows is None else rows, DOCS)
    return df.withColumns({c: F.lit("other") for c in CLASH}) if clash else df


def save(tmp_path, spark, **tables) -> str:
    """Writes tables as one Parquet file each, next to the other test tables."""
    import os

    for name, df in tables.items():
        pdf = df.toPandas()
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        pq.write_table(pa.Table.from_pandas(pdf, to_arrow_schema(df.schema), preserve_index=False), os.path.join(tmp_path, f"{name}.parquet"))
    return str(tmp_path)
