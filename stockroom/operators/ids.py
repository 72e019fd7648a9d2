"""Ids for new rows, in order of receipt, after the highest id in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.numbering import numbered


def assign_ids(rows: DataFrame, order: str, table: DataFrame, name: str) -> DataFrame:
    """Add the ids an auto-increment column would have given the rows, one insert at a time."""
    highest = F.coalesce(table.agg(F.max(name)).scalar(), F.lit(0))
    return numbered(rows, [F.col(order)], "_at").select(
        order, (F.col("_at") + 1 + highest).alias(name), *(c for c in rows.columns if c != order)
    )
