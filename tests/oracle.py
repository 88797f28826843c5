"""Comparison of a Spark query with its SQL, as multisets of rows."""

import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return norm(v.tolist()) if hasattr(v, "tolist") else v


def duck(tables=None):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def compare(df, sql, con):
    rows = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = Counter(repr([norm(r[n]) for n in order]) for r in rows)
    b = Counter(repr([norm(dict(zip(names, r))[n]) for n in order]) for r in cur.fetchall())
    assert a == b, f"only Spark: {list((a - b))[:2]}; only SQL: {list((b - a))[:2]}"
