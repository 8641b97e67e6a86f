"""Compare a query with its SQL: same columns, same rows, whatever the order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(tuple(value))
    if isinstance(value, dict):
        return plain(tuple(value.values()))
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, sql: str, con) -> tuple[list[str], list]:
    """Column lists when they differ, else a few rows only one side has."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"], []
    expected = rows_of(names, result.fetchall())
    found = rows_of(df.columns, df.collect())
    extra, missing = found - expected, expected - found
    report = [f"spark only: {str(r)[:400]}" for r in list(extra)[:3]]
    report += [f"sql only: {str(r)[:400]}" for r in list(missing)[:3]]
    if report:
        report.insert(0, f"{sum(extra.values())} extra, {sum(missing.values())} missing of {sum(expected.values())}")
    return report, list(expected)
