"""Compares a query with its SQL on the smallest test tables."""

import glob
import os
from decimal import Decimal

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f + '/*' if os.path.isdir(f) else f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    cur = connect().execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    want = sorted(repr(tuple(plain(r[cols.index(n)]) for n in names)) for r in cur.fetchall())
    assert got == want
