"""Runs a query and its SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows."""
    ours = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in ours.collect()), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[:2]}" if bad else ""
