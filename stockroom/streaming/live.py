"""Request streams handled batch by batch.

Each micro-batch writes what it adds under ``batch_id=N`` and reads only the
folders of earlier batches, so a batch that is retried sees the same tables and
writes the same folder again. Tables are not rewritten by the stream.

What the batches have written grows, and every batch reads it. From time to
time it is folded into the tables (``pieces_now``, ``tables_after`` and
``write_version``); a stream started on those with ``since=N`` skips the folders
of the batches before ``N``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from stockroom.operators.alerts import alerts_from_counts, available_pieces
from stockroom.operators.joins import only_asked
from stockroom.operators.lookup import lookup_table, resolve
from stockroom.operators.register import (
    register_decisions,
    register_movements,
    register_new_pieces,
    register_new_products,
    tables_after,
)
from stockroom.operators.snapshot import merge_changes
from stockroom.operators.state import status_movements
from stockroom.schemas import TABLES
from stockroom.sources.tables import Tables


def write_batch(frame: DataFrame, root: str, name: str, batch: int) -> None:
    frame.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch}")


def earlier_rows(
    spark: SparkSession, root: str, name: str, schema: StructType, batch: int, since: int = 0
) -> DataFrame:
    """Rows of earlier batches, with ``batch_id``; other folders are not opened."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    try:
        frame = spark.read.schema(full).parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    return frame.where((F.col("batch_id") >= since) & (F.col("batch_id") < batch))


def written(spark: SparkSession, root: str, name: str, schema: StructType) -> DataFrame:
    """All rows the batches have written."""
    return spark.read.schema(schema).parquet(f"{root}/{name}").select(*schema.fieldNames())


def start_batches(stream: DataFrame, root: str, name: str, handle: Callable[[DataFrame, int], None], **trigger):
    def once(batch: DataFrame, batch_id: int) -> None:
        """The steps of a batch read its requests several times; keep them for that long."""
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(once)
        .option("checkpointLocation", f"{root}/_checkpoint/{name}")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def pieces_now(pieces: DataFrame, journal: DataFrame) -> DataFrame:
    """Pieces with the state their journal rows leave them in."""
    last = journal.groupBy("id_pieza").agg(
        F.max_by("estado_nuevo", F.struct("batch_id", "seq")).alias("estado")
    )
    return merge_changes(pieces, last, "id_pieza")


def live_status_stream(
    tables: Tables, changes: DataFrame, root: str, since: int = 0, **trigger
) -> StreamingQuery:
    """State changes as they come; the journal is the state.

    A batch starts from the snapshot and the journal of the earlier batches,
    as far as they concern its pieces.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        schema = TABLES["movimiento"]
        journal = earlier_rows(batch.sparkSession, root, "movimiento", schema, batch_id, since)
        journal = only_asked(journal, batch, "id_pieza")
        pieces = only_asked(tables.pieza, batch, "id_pieza")
        now = tables.with_(pieza=pieces_now(pieces, journal))
        write_batch(status_movements(now, batch), root, "movimiento", batch_id)

    return start_batches(changes, root, "live_status", handle, **trigger)


_NEW_PIECES = StructType([TABLES["movimiento"]["seq"], *TABLES["pieza"].fields])
_NEW_PRODUCTS = StructType([TABLES["movimiento"]["seq"], *TABLES["producto"].fields])


_COUNTS = StructType([TABLES["pieza"]["id_producto"], StructField("disponibles", LongType())])


def _counts_before(spark: SparkSession, tables: Tables, root: str, batch: int, since: int) -> DataFrame:
    """Available pieces per product as the last batch left them; the pieces are counted for the first batch only."""
    if batch == since:
        return available_pieces(tables.pieza)
    return spark.read.schema(_COUNTS).parquet(f"{root}/existencias/batch_id={batch - 1}")


def register_stream(
    tables: Tables, registrations: DataFrame, root: str, prefix: str = "INV", since: int = 0, **trigger
) -> StreamingQuery:
    """Registrations as they come, and the low-stock alerts after each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = tables_after(
            tables,
            earlier_rows(spark, root, "producto", _NEW_PRODUCTS, batch_id, since),
            earlier_rows(spark, root, "pieza", _NEW_PIECES, batch_id, since),
        )
        write_batch(register_decisions(now, batch), root, "decisiones", batch_id)
        write_batch(register_new_products(now, batch), root, "producto", batch_id)
        write_batch(register_new_pieces(now, batch, prefix), root, "pieza", batch_id)
        products = spark.read.schema(_NEW_PRODUCTS).parquet(f"{root}/producto/batch_id={batch_id}")
        pieces = spark.read.schema(_NEW_PIECES).parquet(f"{root}/pieza/batch_id={batch_id}")
        write_batch(register_movements(pieces), root, "movimiento", batch_id)
        counts = available_pieces(pieces).unionByName(_counts_before(spark, tables, root, batch_id, since))
        counts = counts.groupBy("id_producto").agg(F.sum("disponibles").alias("disponibles"))
        write_batch(counts, root, "existencias", batch_id)
        counts = spark.read.schema(_COUNTS).parquet(f"{root}/existencias/batch_id={batch_id}")
        after = tables_after(now, products, pieces)
        write_batch(alerts_from_counts(after.producto, counts), root, "alertas", batch_id)

    return start_batches(registrations, root, "register", handle, **trigger)


def write_lookup_table(tables: Tables, path: str) -> None:
    """Build the lookup table once, so that a stream of scans need not build it for every batch."""
    lookup_table(tables).write.mode("overwrite").parquet(path)


def scan_batch_stream(table: DataFrame, scans: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Scans as they come, resolved with a lookup table of any size.

    The codes of a batch are few: they are sent to the table, which is scanned
    but not shuffled.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(resolve(batch, only_asked(table, batch, "codigo")), root, "hallazgos", batch_id)

    return start_batches(scans, root, "scans", handle, **trigger)
