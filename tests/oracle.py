"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "NULL" if v is None else repr(v) if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in data)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = duck(sf_dir).sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    return len(got[1])
