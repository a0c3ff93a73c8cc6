"""Rows of a Spark result and of its SQL in DuckDB, in a form that compares."""

import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(t[i]) for i in order) for t in tuples), key=repr)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()]), sorted(df.columns)


def duck_rows(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    return rows(names, res.fetchall()), sorted(names)
