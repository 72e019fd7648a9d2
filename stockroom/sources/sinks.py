"""Sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_rows(frame: DataFrame, path: str) -> None:
    """One JSON object per row; NULL fields are kept."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_rows(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_lines(frame: DataFrame, column: str, path: str) -> None:
    """One text per line."""
    frame.select(column).write.mode("overwrite").text(path)
