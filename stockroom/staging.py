"""Intermediate tables that cut the lineage and survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockroom.session import shared_folder


def staged(rows: DataFrame, label: str) -> DataFrame:
    """Write ``rows`` once as Parquet into the shared folder and read them from there.

    Unlike a checkpoint the copy is compressed and columnar: later steps read
    only the columns that they use. A task that is repeated replaces its own
    file, as with any Spark write. A table stays until ``discard`` or until the
    folder is cleared.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, label)
    rows.write.parquet(folder)
    table = spark.read.schema(rows.schema).parquet(folder)
    table.staged_in = folder
    return table


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` wrote; nothing may read them any more."""
    for table in tables:
        delete_folder(table.sparkSession, table.staged_in)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not use, in whatever case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
