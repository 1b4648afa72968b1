"""Spark results against DuckDB's, as multisets of rows with columns by name."""

import glob
import math
import os

import duckdb

SF = os.environ.get("SKEIN_SF", "/root/testdata/sf0.01")


def connect(sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        at = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, fn, sql, sf=SF):
    df = fn(spark, sf)
    got = rows(df.columns, df.collect())
    con = connect(sf)
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows(want_cols, cur.fetchall())
    assert sorted(df.columns) == sorted(want_cols)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]
    return len(got)
