"""Compare a query with its SQL on DuckDB, row by row and exactly."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.UTC).replace(tzinfo=None)
    return value


def table(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple(map(repr, r)))


def check(df, con, sql) -> list[str]:
    """What differs, empty when nothing does."""
    found = con.execute(sql)
    want_columns, want = table([d[0] for d in found.description], found.fetchall())
    columns, got = table(df.columns, [tuple(r) for r in df.collect()])
    if columns != want_columns:
        return [f"columns {columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    bad = []
    for a, b in zip(got, want, strict=True):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b, strict=True)):
            bad.append(f"{a} != {b}")
    return bad[:3] + ([f"... {len(bad)} rows differ"] if len(bad) > 3 else [])
