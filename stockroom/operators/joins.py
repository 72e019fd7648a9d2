"""Joins of request batches with tables that hold one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from stockroom.functions import text


def _binary(kind: DataType) -> bool:
    """Are values of the type equal only if their bytes are?"""
    if isinstance(kind, StructType):
        return all(_binary(f.dataType) for f in kind.fields)
    return not isinstance(kind, StringType) or kind.simpleString() == "string"


def lookup_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join ``rows``, where a key may be very frequent, with ``table``, where it is unique.

    ``table`` often comes out of an aggregation by the same key. Spark would
    then join on the partitioning it already has, and a hot key's rows would
    stay in one task: adaptive execution splits a skewed partition only where
    both inputs are shuffled for the join. The second equality is redundant,
    but asks for that shuffle of the (narrow) table; the frequent key is split
    at run time, whatever its share. Small tables are broadcast as always.
    """
    if not _binary(rows.schema[key].dataType) or not _binary(table.schema[key].dataType):
        return rows.join(table, key, "left")
    guard = F.xxhash64(F.col(key))
    spread = guard
    if "seq" in rows.columns:  # rows without a key find nothing, wherever they go
        spread = F.when(F.col(key).isNull(), F.xxhash64("seq")).otherwise(guard)
    left = rows.select("*", spread.alias("_guard"))
    right = table.select("*", guard.alias("_guard"))
    return left.join(right, [key, "_guard"], "left").drop("_guard")


def only_asked(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The part of a large table whose keys occur in ``rows``.

    For a small batch its keys are broadcast and the table is only scanned; for
    a large one both are shuffled once by the key.
    """
    return table.join(rows.select(key).distinct(), key, "left_semi")


def first_match(table: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the one with the lowest ``order``."""
    payload = F.struct(*(F.col(c) for c in columns))
    return (
        table.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(payload, F.col(order)).alias("_first"))
        .select(key, *(F.col(f"_first.{c}").alias(c) for c in columns))
    )


def with_existence(rows: DataFrame, key: str, table: DataFrame, table_key: str, flag: str) -> DataFrame:
    """Add a boolean: does ``table`` hold the key?"""
    held = only_asked(table.select(F.col(table_key).alias(key)), rows, key).distinct().withColumn("_held", F.lit(True))
    return lookup_join(rows, held, key).withColumn(flag, F.col("_held").isNotNull()).drop("_held")


def unseen(
    rows: DataFrame, key: str, table: DataFrame, table_key: str, asked: DataFrame | None = None
) -> DataFrame:
    """The rows whose key is not in ``table``; ``rows`` hold each key once.

    ``asked`` may name a cheaper source of the keys than ``rows``, and may hold more of them.
    """
    held = only_asked(table.select(F.col(table_key).alias(key)), rows if asked is None else asked, key)
    return rows.join(held, key, "left_anti")


def decide(*checks: tuple[Column, int, str], done: str | None = None) -> list[Column]:
    """``accepted``, ``status`` and ``reason`` from checks in order; the first that fires rejects.

    With ``done``, a text with fields to fill from the row, also ``mensaje`` for accepted rows.
    """
    status, reason = F, F
    for fires, code, why in checks:
        status = status.when(fires, F.lit(code))
        reason = reason.when(fires, F.lit(why))
    rejected = F.lit(False)
    for fires, _, _ in checks:
        rejected = rejected | F.coalesce(fires, F.lit(False))
    columns = [
        (~rejected).alias("accepted"),
        status.otherwise(F.lit(200)).alias("status"),
        reason.otherwise(F.lit(None).cast("string")).alias("reason"),
    ]
    if done is not None:
        columns.append(F.when(~rejected, text.filled(done)).alias("mensaje"))
    return columns
