"""Comparison of a query with its SQL on DuckDB."""

import decimal
import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"create view {name} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def same(df, con, sql):
    """The rows that only one side has, none where both agree."""
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())
    ours, theirs = set(got), set(want)
    return got == want, sorted(ours - theirs)[:3], sorted(theirs - ours)[:3]
