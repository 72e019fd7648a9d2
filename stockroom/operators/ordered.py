"""Values that depend on the earlier rows of the same key.

A plain window would put all rows of a key into one task. Here the rows are
dealt out by ranges of the order and written once, so the ranges are fixed
before they are read twice. Windows run inside a range, or over the one row per
key and range that a range hands on, made by an aggregation that combines before
the shuffle: at most as many rows as there are ranges, whatever the share of the
key and however the sequence numbers are spaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.staging import staged


def _chunked(rows: DataFrame, order: str, ranges: int | None) -> DataFrame:
    """The rows with ``_chunk``, the number of their range."""
    dealt = rows.repartitionByRange(ranges, order) if ranges else rows.repartitionByRange(order)
    return staged(dealt.withColumn("_chunk", F.spark_partition_id()), "ordered")


def _earlier(*keys: str, order: str):
    return (
        Window.partitionBy(*keys)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def previous_value(
    rows: DataFrame, key: str, order: str, value: Column, name: str, ranges: int | None = None
) -> DataFrame:
    """Add the last non-NULL ``value`` among the earlier rows of the key."""
    rows = _chunked(rows.select("*", value.alias("_value")), order, ranges)
    inside = F.last("_value", ignorenulls=True).over(_earlier(key, "_chunk", order=order))
    at = F.when(F.col("_value").isNotNull(), F.col(order))
    ends = rows.groupBy(key, "_chunk").agg(F.max_by("_value", at).alias("_end"))
    carried = _carry(ends, key, F.last("_end", ignorenulls=True))
    return (
        rows.withColumn("_inside", inside)
        .join(carried, [key, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_value", "_inside", "_carried")
    )


def running_count(rows: DataFrame, key: str, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the position (from 1) of a row among the rows of its key."""
    rows = _chunked(rows, order, ranges)
    inside = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order))
    ends = rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_end"))
    carried = _carry(ends, key, F.sum("_end"))
    return (
        rows.withColumn("_inside", inside.cast("bigint"))
        .join(carried, [key, "_chunk"], "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_carried", F.lit(0)))
        .drop("_chunk", "_inside", "_carried")
    )


def running_sum(
    rows: DataFrame, key: str, order: str, value: Column, name: str, ranges: int | None = None
) -> DataFrame:
    """Add the sum of ``value``, a whole number, over the earlier rows of the key."""
    rows = _chunked(rows.select("*", value.cast("bigint").alias("_value")), order, ranges)
    inside = F.sum("_value").over(_earlier(key, "_chunk", order=order))
    ends = rows.groupBy(key, "_chunk").agg(F.sum("_value").alias("_end"))
    carried = _carry(ends, key, F.sum("_end"))
    return (
        rows.withColumn("_inside", inside)
        .join(carried, [key, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
        .drop("_chunk", "_value", "_inside", "_carried")
    )


def _carry(ends: DataFrame, key: str, fold: Column) -> DataFrame:
    """Fold what the earlier chunks of the key hand on; ``ends`` has one row per key and chunk."""
    carried = fold.over(_earlier(key, order="_chunk"))
    return ends.select(key, "_chunk", carried.alias("_carried")).where(F.col("_carried").isNotNull())
