"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(row[k]) for k in order) for row in rows), key=repr)


def same(x, y) -> bool:
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(same(a, b) for a, b in zip(x, y, strict=True))
    return x == y


def compare(spark, query, sql: str, sf_dir: str) -> tuple[str, int, int]:
    """("" or what differs, rows, rows that differ at all)."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}", len(got), len(want)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {got[:2]} / {want[:2]}", len(got), len(want)
    off = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    bad = [p for p in off if not same(*p)]
    return (f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""), len(got), len(off)
