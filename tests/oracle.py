"""Side-by-side comparison of a Spark query with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from linewright.plans.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in map(tuple, rows)), key=repr
    )


def compare(df, con, sql: str) -> tuple[int, str | None]:
    """Row count and the first difference, or None."""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = _rows(columns, result.fetchall())
    got = _rows(df.columns, df.collect())
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(expected):
        return len(got), f"{len(got)} rows against {len(expected)}"
    bad = [(a, b) for a, b in zip(got, expected) if a != b]
    if bad:
        return len(got), f"{len(bad)} rows differ, first: {bad[0][0]} against {bad[0][1]}"
    return len(got), None
