"""Resolving scanned codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.joins import (
    decide,
    first_match,
    lookup_join,
    only_asked,
    unseen,
    with_existence,
)
from stockroom.sources.tables import Tables

_PIECE = ["id_pieza", "numero_serie", "estado", "caja", "nombre_producto"]
_PRODUCT = ["id_producto", "codigo_original", "nombre", "descripcion", "id_dron"]


def _keyed_pieces(tables: Tables) -> DataFrame:
    """Pieces under their bar code (first) and their serial (second), in one pass over the table."""
    keys = F.array(
        F.struct(F.col("codigo_barras").alias("codigo"), F.lit(1).alias("prioridad")),
        F.struct(F.col("numero_serie").alias("codigo"), F.lit(2).alias("prioridad")),
    )
    return tables.pieza.select(
        F.inline(keys), "id_pieza", "id_producto", "numero_serie", "estado", "caja"
    ).where(F.col("codigo").isNotNull())


def _with_product_name(pieces: DataFrame, tables: Tables) -> DataFrame:
    """Inner join: a piece without a product is not found."""
    names = tables.producto.select("id_producto", F.col("nombre").alias("nombre_producto"))
    return pieces.join(names, "id_producto").drop("id_producto")


def lookup_table(tables: Tables, asked: DataFrame | None = None) -> DataFrame:
    """One row per code: what a scan of the code finds.

    With ``asked`` (a column ``codigo``) only those codes are resolved, so a
    small batch does not shuffle the pieces.
    """
    pieces = _keyed_pieces(tables)
    products = tables.producto.select(F.col("codigo_original").alias("codigo"), *_PRODUCT).where(
        F.col("codigo").isNotNull()
    )
    if asked is not None:
        pieces = only_asked(pieces, asked, "codigo")
        products = only_asked(products, asked, "codigo")
    pieces = _with_product_name(pieces, tables).withColumn("_id", F.col("id_pieza"))
    products = products.withColumns({"prioridad": F.lit(3), "_id": F.col("id_producto")})
    everything = pieces.unionByName(products, allowMissingColumns=True)
    best = F.min_by(F.struct("prioridad", *_PIECE, *_PRODUCT), F.struct("prioridad", "_id"))
    return everything.groupBy("codigo").agg(best.alias("_hit")).select("codigo", "_hit.*")


def resolve(scans: DataFrame, table: DataFrame) -> DataFrame:
    """Join scans with a lookup table; the code that finds nothing belongs to a new product."""
    return _shape(lookup_join(scans.select("seq", "codigo"), table, "codigo"))


def _shape(rows: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("prioridad") <= 2, M.KIND_PIECE)
        .when(F.col("prioridad") == 3, M.KIND_PRODUCT)
        .otherwise(M.KIND_NEW)
    )
    echo = F.when(F.col("prioridad").isNull(), F.col("codigo")).otherwise(F.col("codigo_original"))
    return rows.select(
        "seq", "codigo", kind.alias("tipo"), *_PIECE,
        "id_producto", echo.alias("codigo_original"), "nombre", "descripcion", "id_dron",
    )


def scan_lookup(tables: Tables, scans: DataFrame) -> DataFrame:
    """First hit wins: bar code, then serial, then supplier code, else a new product."""
    return resolve(scans, lookup_table(tables, scans))


def scan_display(found: DataFrame) -> DataFrame:
    """What the scan form shows, and the form it opens next."""
    piece, product = F.col("tipo") == M.KIND_PIECE, F.col("tipo") == M.KIND_PRODUCT
    action = (
        F.when(piece, "actualizar_estado").when(product, "registrar_pieza").otherwise("registrar_producto")
    )
    return found.select(
        "seq",
        "tipo",
        action.alias("accion"),
        F.when(piece, text.first_given(F.col("nombre_producto"), M.NOT_AVAILABLE))
        .when(product, F.col("nombre"))
        .alias("producto_mostrado"),
        F.when(piece, text.first_given(F.col("caja"), M.NOT_AVAILABLE)).alias("caja_mostrada"),
        F.when(product, F.coalesce("descripcion", F.lit(""))).alias("descripcion_mostrada"),
        F.when(~piece, F.col("codigo_original")).alias("codigo_mostrado"),
    )


def scan_form(scans: DataFrame) -> DataFrame:
    """The scan form trims a code and sends none that is empty."""
    code = text.form_trim(F.col("codigo"))
    return scans.select("seq", code.alias("codigo")).select(
        "seq", "codigo", *decide((text.blank(F.col("codigo")), 400, M.FORM_NO_CODE))
    )


def piece_by(tables: Tables, asked: DataFrame, column: str) -> DataFrame:
    """Pieces found by one of their codes (``codigo_barras`` or ``numero_serie``), lowest id first.

    ``asked`` holds ``seq`` and ``codigo``; codes that find nothing give no row.
    """
    pieces = tables.pieza.select(
        F.col(column).alias("codigo"), "id_pieza", "id_producto", "numero_serie", "estado", "caja"
    )
    pieces = _with_product_name(only_asked(pieces, asked, "codigo"), tables)
    found = first_match(pieces, "codigo", "id_pieza", _PIECE)
    return lookup_join(asked.select("seq", "codigo"), found, "codigo").where(F.col("id_pieza").isNotNull())


def exists(asked: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """``seq``, the key and a flag: is it known?"""
    held = only_asked(table.select(F.col(table_key).alias(key)), asked, key)
    return with_existence(asked.select("seq", key), key, held, key, "existe")


def new_serials(tables: Tables, asked: DataFrame) -> DataFrame:
    """Serials of a batch that no piece has, with the first request that names each."""
    first = asked.groupBy("numero_serie").agg(F.min("seq").alias("seq"))
    return unseen(first, "numero_serie", tables.pieza, "numero_serie")
