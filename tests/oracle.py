"""Runs a query and its SQL on the same small tables."""

import datetime
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def there() -> bool:
    return Path(SF).is_dir()


def connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else repr(v)


def same(spark, query, sql: str) -> None:
    df, found = query(spark, SF), connect().sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    left = sorted(tuple(_cell(r[c]) for c in names) for r in df.collect())
    right = sorted(tuple(_cell(dict(zip(found.columns, r, strict=True))[c]) for c in names) for r in found.fetchall())
    assert left == right
