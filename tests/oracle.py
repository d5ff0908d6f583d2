"""Compare a query with its SQL in DuckDB, as unordered rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(_plain(y) for y in x.values())
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str, least: int = 0) -> None:
    result = connect(sf_dir).sql(sql)
    want = rows_of(result.columns, result.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(result.columns)
    for a, b in zip(got, want):
        assert a == b, f"\n{a}\n{b}"
    assert len(got) == len(want) and len(got) >= least
