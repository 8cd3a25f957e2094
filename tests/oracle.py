"""Rows of a Spark query and of its DuckDB SQL, in a comparable form."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path


def database(folder: str):
    import duckdb

    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def compared(df, sql: str, db) -> tuple[Counter, Counter, list[str], list[str]]:
    got = db.execute(sql)
    names = [c[0] for c in got.description]
    return rows(df.columns, df.collect()), rows(names, got.fetchall()), sorted(df.columns), sorted(names)
