"""Rows of a query and of its SQL in one form, so that they can be compared."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def spark_rows(df) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    with duckdb.connect() as db:
        db.execute("SET TimeZone = 'UTC'")
        for path in Path(sf_dir).glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        out = db.execute(sql)
        columns = [c[0] for c in out.description]
        return sorted(columns), rows_of(columns, out.fetchall())
