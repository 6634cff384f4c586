"""Comparison of queries with their SQL twins."""

import decimal
import os
from collections import Counter

import duckdb

DATA = os.environ.get("SPARKSEEK_TESTDATA", "/root/testdata/sf0.001")


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def bag(rows):
    return Counter(tuple(normal(v) for v in r) for r in rows)


def oracle(folder=DATA):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{folder}/{t}')")
    return con


def same(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = bag(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    got = bag(df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
