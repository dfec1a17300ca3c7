"""Hold a Spark result against DuckDB's: rows without order, columns by name."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(folder, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if isinstance(x, bytes | bytearray):
        return bytes(x)
    return x


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if both agree."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows(names, got.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:2]
        return f"{len(ours)} and {len(theirs)} rows; first differences {bad}"
    return ""
