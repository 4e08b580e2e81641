"""Compare a registered query with its SQL counterpart: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6)
    if isinstance(v, int):
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short report."""
    left = normal(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = normal(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if left == right:
        return None
    a, b = set(map(repr, left)), set(map(repr, right))
    return f"rows {len(left)}/{len(right)}; only spark {sorted(a - b)[:4]}; only sql {sorted(b - a)[:4]}"
