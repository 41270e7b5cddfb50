"""Runs a query and its SQL over the same Parquet files and gives both results in one form."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x: object) -> object:
    if x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, bool):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(float(x), 9) if isinstance(x, (int, float)) else str(x)


def both(spark, query, sql: str) -> tuple[list, list]:
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TABLE wanted AS {sql}")
    names = [r[0] for r in con.execute("SELECT column_name FROM (DESCRIBE wanted)").fetchall()]
    assert sorted(names) == columns
    want = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM wanted").fetchall()
    return got, sorted((tuple(plain(v) for v in r) for r in want), key=repr)
