"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def normal(columns: list[str], rows: list) -> list[tuple]:
    """Rows with their columns in order of name, numbers to five decimals."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None else f"{r[i] + 0.0:.5f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def assert_same(spark, con, sf_dir: str, query, sql: str) -> None:
    got, want = query(spark, sf_dir), con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal(got.columns, got.collect()) == normal(names, want.fetchall())
