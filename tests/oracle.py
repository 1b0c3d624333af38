"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if v != v else repr(v)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return str([plain(x) for x in v])
    return v if v is None or isinstance(v, bool) else str(v)


def connect() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def check(spark, query, sql: str) -> int:
    df = query(spark, DATA)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = connect().sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert rows == want
    return len(rows)
