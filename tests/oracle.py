"""Runs a query and its SQL over the same tables and compares rows as multisets."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    df = query(spark, sf)
    con.execute(sql)
    got = by_name(df.columns, [tuple(r) for r in df.collect()])
    want = by_name([d[0] for d in con.description], con.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert got[1] == want[1], (name, list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
    return sum(got[1].values())
