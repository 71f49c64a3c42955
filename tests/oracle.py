"""Compare a registered query with its SQL as the driver does: names, rows and values, in any order."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp,)):
        return str(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    got = rows_of(got.columns, [tuple(r) for r in got.collect()])
    rel = duck(sf_dir).sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (a, b)
    return len(got[1])
