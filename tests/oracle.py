"""Compares a query's rows with its SQL over the same Parquet files in DuckDB, by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(show(row[i]) for i in order) for row in rows)


def difference(df, sql: str, con) -> str:
    """Empty if they agree."""
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, found.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first {got[:1]} and {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""
