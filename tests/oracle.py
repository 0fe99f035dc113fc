"""Runs queries beside their SQL and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v if not isinstance(v, (list, dict)) else str(v)) for v in row)


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v)
    return str(v)


def differences(spark_df, con, sql: str, tolerance: float = 2e-6) -> str | None:
    """None if the rows agree, else what differs first."""
    cols = sorted(spark_df.columns)
    mine = [tuple(_cell(v) for v in r) for r in spark_df.select(*cols).collect()]
    made = con.execute(sql)
    names = [d[0] for d in made.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = [tuple(_cell(r[i]) for i in order) for r in made.fetchall()]
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    if not mine:
        return "no rows"
    mine.sort(key=_key)
    theirs.sort(key=_key)
    n = 0
    first = None
    for a, b in zip(mine, theirs):
        same = all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(1, abs(x)) for x, y in zip(a, b))
        exact = a == b
        n += not exact
        if not same and first is None:
            first = (a, b)
    if first:
        return f"{cols}: {first[0]} and {first[1]}; {n} rows differ"
    return f"{n} of {len(mine)} rows differ in the last digit" if n else None
