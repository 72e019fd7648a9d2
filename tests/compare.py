"""Compare a Spark result with a DuckDB result, whatever their row order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in SOURCES:
        path = Path(sf_dir) / f"{name}.parquet"
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and pd.isna(value)):
        return "NULL"
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted(tuple(_cell(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], body


def spark_rows(frame):
    return normal(frame.columns, [tuple(r) for r in frame.collect()])


def duck_rows(db, sql: str):
    result = db.execute(sql)
    return normal([c[0] for c in result.description], result.fetchall())


_SAME_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def type_differences(frame, db, sql: str) -> list[str]:
    kinds = {r[0]: r[1] for r in db.execute(f"describe {sql}").fetchall()}
    mine = dict(frame.dtypes)
    return [
        f"{c}: {mine.get(c)} / {kinds[c]}" for c in kinds if mine.get(c) != _SAME_TYPE.get(kinds[c], kinds[c])
    ]
