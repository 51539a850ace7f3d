"""Runs a registered query and its SQL on the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    cols, want = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(cols), (df.columns, cols)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(cols, want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        raise AssertionError(f"{len(a)} rows, SQL {len(b)}; only here {sorted(sa - sb)[:4]}; only SQL {sorted(sb - sa)[:4]}")
    return len(a)
