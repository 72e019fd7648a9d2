"""Positions in a global order, found without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.staging import fresh, staged

#: ``monotonically_increasing_id`` keeps the partition above 33 bits of position.
_POSITION_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Add the position (from 0) of each row in ``order``.

    The rows are dealt out by ranges of the order, sorted inside each range and
    written once, so that the ranges are fixed before they are read twice. Only
    the counts, one row per range, meet in one place. Rows that tie completely
    take neighbouring positions in any order.
    """
    slot = fresh(rows, "_slot")
    ranges = (
        rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ).sortWithinPartitions(*order)
    table = staged(ranges.withColumn(slot, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(slot, _POSITION_BITS)
    sizes = table.select(part.alias("_chunk")).groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    position = F.col(slot).bitwiseAND((1 << _POSITION_BITS) - 1)
    # one row per range: a few thousand at most, whatever the number of rows
    return (
        table.join(F.broadcast(starts), part == F.col("_chunk"))
        .withColumn(name, F.col("_start") + position)
        .drop(slot, "_chunk", "_start")
    )
