"""Rows of a query against rows of its SQL."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if v == v else "nan"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql: str) -> None:
    relation = con.sql(sql)
    columns = sorted(relation.columns)
    assert columns == sorted(df.columns)
    ours = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    theirs = Counter(tuple(map(plain, r)) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
