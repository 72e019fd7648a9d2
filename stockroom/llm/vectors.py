"""Vectors of many rows at once, for tasks that run in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.staging import fresh


def finite(vector: Column) -> Column:
    """Is the vector there, without NULL, NaN and infinite entries?"""
    limit = F.lit(float("inf"))
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)
    return vector.isNotNull() & F.coalesce(F.forall(vector, entry), F.lit(False))


def as_vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, vector``: the vectors as arrays of doubles."""
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column, whose rows all have ``width`` entries, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``rows`` rows; small batches are put together."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            kept, n, batch = [*kept, part], n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                yield pa.concat_batches(kept)
                kept, n = [], 0
    if kept:
        yield pa.concat_batches(kept)


def one_length(table: DataFrame) -> tuple[DataFrame, int]:
    """The rows with the commonest length of vector, the longer one if lengths tie, and that length."""
    size = fresh(table, "_size")
    sized = table.withColumn(size, F.size("vector"))
    top = sized.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(size).desc()).head()
    width = top[0] if top else 0
    return sized.where(F.col(size) == width).drop(size), width


def summed(parts: DataFrame) -> np.ndarray:
    """The sums of ``parts(at, value)`` by position; there are as many as the job has dimensions or components."""
    total = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(max(total.column("at").to_pylist(), default=-1) + 1)
    out[total.column("at").to_numpy()] = total.column("value").to_numpy()
    return out


def part_rows(values: np.ndarray) -> pa.RecordBatch:
    """One row of ``at, value`` for each entry."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"]
    )
