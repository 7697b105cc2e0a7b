"""Run a query and its SQL twin on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

from tallygrove.session import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if v is not None and type(v).__name__ == "Decimal":
        return _cell(float(v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> int:
    """Assert equal rows whatever their order; returns how many."""
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert mine[0] == theirs[0], (mine[0], theirs[0])
    assert len(mine[1]) == len(theirs[1]), (len(mine[1]), len(theirs[1]))
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b and not _close(a, b)]
    assert not bad, (len(bad), bad[:3])
    return len(mine[1])


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(_close(x, y) for x, y in zip(a, b))
    return a == b
