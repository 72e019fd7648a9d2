"""The movement journal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from stockroom.schemas import TABLES


def movements_all(*movements: DataFrame) -> DataFrame:
    """Journal rows of several kinds of requests as one table, ready to append."""
    columns = TABLES["movimiento"].fieldNames()
    return reduce(DataFrame.unionByName, (m.select(*columns) for m in movements))
