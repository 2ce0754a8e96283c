"""Compare a registered query with its SQL twin on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with a view for each table of the folder."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def plain(x):
    """A value that compares alike whichever engine it is from."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 2**53 else x
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows(columns: list[str], data: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result: nothing if they agree."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    out = [f"{len(got)} rows and {len(want)}"] if len(got) != len(want) else []
    return out + [f"{a} and {b}" for a, b in zip(got, want) if a != b][:3]
