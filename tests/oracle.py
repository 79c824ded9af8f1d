"""Compare a query with its SQL."""

from __future__ import annotations

import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return tuple(map(plain, x))
    return float(x) if isinstance(x, decimal.Decimal) else x


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(df, sql, con):
    got = Counter(repr(tuple(map(plain, r))) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
