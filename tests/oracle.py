"""Runs a query's SQL in DuckDB over the same tables and compares rows without regard to order."""

import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, Decimal):
        return float(v)
    return float(v)


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(value(r[i]) for i in order) for r in data)


def same(df, con, sql):
    result = con.sql(sql)
    got_names, got = rows(df.collect(), df.columns)
    names, expected = rows(result.fetchall(), result.columns)
    assert got_names == names
    assert got == expected, f"{list((got - expected).items())[:3]} instead of {list((expected - got).items())[:3]}"
