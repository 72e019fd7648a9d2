"""All requests as one stream, on tables that are kept in buckets.

A line is a request as JSON with its kind in ``tipo``. Each micro-batch is
handled as a batch of mixed kinds (``operators/mixed``) against the tables as
the batch before left them; its changes become the next version, in which only
the buckets that it touched are new. Available pieces per product are counted
once, when the store is opened; from then on every journal row adds or takes
one, so registrations, changes of state and checkouts all reach the low-stock
alerts. A batch that is retried reads the same version and writes the same one
again.

The order of requests is that of ``seq`` within a batch; a batch comes after
all batches before it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from stockroom import messages as M
from stockroom.operators import mixed
from stockroom.operators.alerts import alerts_from_counts, available_pieces
from stockroom.operators.joins import lookup_join, only_asked
from stockroom.schemas import PRIMARY_KEYS, TABLES
from stockroom.sources.buckets import BucketedTable, by_hash
from stockroom.sources.requests import parsed_requests, refused_decisions, sound_requests, write_quarantine
from stockroom.sources.tables import Tables
from stockroom.staging import discard, staged
from stockroom.streaming.live import start_batches, write_batch

BUCKETS = 64
COUNTS = StructType([TABLES["pieza"]["id_producto"], StructField("disponibles", LongType())])
# Fixed value: reason for a request whose kind is not known.
NO_KIND = "tipo: Input should be a valid kind"


class Store:
    """The tables of an inventory in buckets; version 0 is what the store was opened with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.root = root
        keyed = lambda name, schema, key: BucketedTable(spark, f"{root}/tablas", name, schema, key, by_hash(key, buckets))
        self.pieza, self.producto, self.usuario = (
            keyed(name, TABLES[name], PRIMARY_KEYS[name]) for name in ("pieza", "producto", "usuario")
        )
        self.existencias = keyed("existencias", COUNTS, "id_producto")

    def open(self, tables: Tables) -> None:
        for name in ("pieza", "producto", "usuario"):
            getattr(self, name).create(getattr(tables, name))
        self.existencias.create(available_pieces(tables.pieza))

    def tables(self, version: int, dron: DataFrame) -> Tables:
        return Tables(
            pieza=lambda: self.pieza.read(version), producto=lambda: self.producto.read(version),
            usuario=lambda: self.usuario.read(version), dron=dron,
        )

    def alerts(self, version: int) -> DataFrame:
        return alerts_from_counts(self.producto.read(version), self.existencias.read(version))

    def expire(self, version: int) -> None:
        """Delete what no version from ``version`` on reads."""
        for table in (self.pieza, self.producto, self.usuario, self.existencias):
            table.expire(version)

    def advance(self, version: int, changes: mixed.Changes, movements: DataFrame) -> None:
        """Write ``version`` from the one before."""
        only = lambda rows, name: rows.select(*TABLES[name].fieldNames())
        added = only(changes.new_pieces, "pieza")
        deltas = staged(self._deltas(version - 1, added, movements), "deltas")
        self.producto.update(version, added=only(changes.new_products, "producto"))
        self.usuario.update(version, changes.user_patches, only(changes.new_users, "usuario"))
        self.pieza.update(version, changes.piece_patches, added)
        before = self.existencias.read(version - 1, deltas)
        counts = lookup_join(deltas, before, "id_producto").select(
            "id_producto", (F.coalesce("disponibles", F.lit(0)) + F.col("cambio")).alias("disponibles")
        )
        self.existencias.replace(version, deltas.select("id_producto"), counts)
        discard(deltas)

    def _deltas(self, version: int, added: DataFrame, movements: DataFrame) -> DataFrame:
        """``id_producto, cambio``: by how many pieces each product's available ones change."""
        there = lambda c: F.coalesce((F.col(c) == M.STATE_REGISTERED).cast("bigint"), F.lit(0))
        change = there("estado_nuevo") - there("estado_anterior")
        moved = movements.groupBy("id_pieza").agg(F.sum(change).alias("cambio")).where("cambio <> 0")
        known = only_asked(self.pieza.read(version, movements.select("id_pieza")), moved, "id_pieza")
        pieces = known.unionByName(added).select("id_pieza", "id_producto")
        return moved.join(pieces, "id_pieza").groupBy("id_producto").agg(F.sum("cambio").alias("cambio")).where("cambio <> 0")


def handle_lines(store: Store, dron: DataFrame, lines: DataFrame, batch: int) -> None:
    """Handle the lines ``raw`` of one batch: decisions, quarantine, journal, the next version, alerts."""
    kind = F.try_variant_get(F.try_parse_json("raw"), "$.tipo", "string")
    told = lines.select("raw", kind.alias("tipo")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        present = {r[0] for r in told.where(F.col("tipo").isin(list(mixed.KINDS))).select("tipo").distinct().collect()}
        parsed = {k: parsed_requests(told.where(F.col("tipo") == k), k) for k in mixed.KINDS if k in present}
        outcome = mixed.handle_batch(
            store.tables(batch, dron), {k: sound_requests(rows, k) for k, rows in parsed.items()}
        )
        movements = staged(outcome.movements, "movements")
        unknown = told.where(~F.coalesce(F.col("tipo").isin(list(mixed.KINDS)), F.lit(False)))
        answers = outcome.decisions
        for k, rows in parsed.items():
            answers = answers.unionByName(refused_decisions(rows).withColumn("tipo", F.lit(k)), allowMissingColumns=True)
            write_quarantine(rows, f"{store.root}/rechazos", k, batch)
        refused = unknown.select(
            F.try_variant_get(F.try_parse_json("raw"), "$.seq", "bigint").alias("seq"), "tipo",
            F.lit(False).alias("accepted"), F.lit(422).alias("status"), F.lit(NO_KIND).alias("reason"),
        )
        answers = answers.unionByName(refused, allowMissingColumns=True)
        write_batch(answers, store.root, "decisiones", batch)
        write_batch(movements, store.root, "movimiento", batch)
        store.advance(batch + 1, outcome.changes, movements)
        write_batch(store.alerts(batch + 1), store.root, "alertas", batch)
        discard(movements)
    finally:
        told.unpersist()


def inventory_stream(store: Store, dron: DataFrame, lines: DataFrame, **trigger) -> StreamingQuery:
    """Lines of JSON as they come, in a column ``value``."""
    raw = lines.select(F.col("value").alias("raw"))
    return start_batches(raw, store.root, "inventario", lambda batch, n: handle_lines(store, dron, batch, n), **trigger)
