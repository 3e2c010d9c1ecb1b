"""Runs a registered query and its SQL on the same tables and compares whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _same(x, y) -> bool:
    """Equal, or rounded numbers one apart in the last place: a mean of cents can lie exactly half way,
    and the engines' sums differ in their last bit. Money is rounded to three places, the rest to six."""
    if x == y:
        return True
    if not (isinstance(x, float) and isinstance(y, float)):
        return False
    return abs(x - y) < (1.01e-3 if abs(x) >= 100 else 1.01e-6)


def compare(spark, con, query, sql, sf) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf)
    sc, sr = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    dc, dr = _rows([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    for a, b in zip(sr, dr):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"first difference: spark {a} sql {b}"
    for i, c in enumerate(sc):
        kinds = {type(r[i]) for r in sr if r[i] is not None}, {type(r[i]) for r in dr if r[i] is not None}
        if kinds[0] != kinds[1]:
            return f"types of {c}: {kinds}"
    return None
