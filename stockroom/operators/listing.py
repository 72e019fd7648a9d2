"""The joined inventory: listing, filter, counts; the list of models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.sources.tables import Tables


@dataclass(frozen=True)
class InventoryFilter:
    """An empty text lets everything pass."""

    serie: str = ""
    estado: str = ""
    producto: str = ""


def products_with_models(tables: Tables) -> DataFrame:
    """One row per product, joined with its model before any piece is touched."""
    models = tables.dron.select(F.col("id").alias("id_dron"), F.col("nombre").alias("nombre_dron"))
    products = tables.producto.select("id_producto", F.col("nombre").alias("nombre_producto"), "id_dron")
    return products.join(models, "id_dron", "left").drop("id_dron")


def joined_pieces(tables: Tables) -> DataFrame:
    """Pieces with product, model and user; pieces whose product or user is gone stay.

    The joins carry no hints: a small side is broadcast by its measured size, a
    large one is shuffled, and a product that holds much of the inventory is
    split by adaptive execution.
    """
    users = tables.usuario.select("id_usuario", "nombre_usuario")
    return (
        tables.pieza.join(products_with_models(tables), "id_producto", "left")
        .join(users, "id_usuario", "left")
    )


def newest_first() -> list[Column]:
    return [F.desc("fecha_registro"), F.desc("id_pieza")]


def inventory_rows(tables: Tables, where: InventoryFilter = InventoryFilter()) -> DataFrame:
    """The listing in no particular order, filtered before it is joined where possible."""
    rows = joined_pieces(tables)
    if where.serie:
        rows = rows.where(text.contains_ignoring_case(F.col("numero_serie"), where.serie))
    if where.estado:
        rows = rows.where(F.col("estado") == where.estado)
    if where.producto:
        rows = rows.where(F.col("nombre_producto") == where.producto)
    return rows.select(
        "id_pieza",
        "codigo_barras",
        "numero_serie",
        "estado",
        "caja",
        "fecha_registro",
        "nombre_producto",
        "nombre_dron",
        F.coalesce("nombre_usuario", F.lit(M.DELETED_USER)).alias("nombre_usuario"),
    )


def inventory_listing(tables: Tables, where: InventoryFilter = InventoryFilter()) -> DataFrame:
    """The listing, newest first."""
    return inventory_rows(tables, where).orderBy(*newest_first())


def inventory_display(listing: DataFrame, rol: str | None = None) -> DataFrame:
    """Rows as shown, with a flag: may a user of this role check the piece out?"""
    permitted = rol in M.ROLES_CHECKOUT
    return listing.withColumns(
        {
            "nombre_usuario": text.first_given(F.col("nombre_usuario"), M.NOT_AVAILABLE),
            "salida_posible": F.coalesce(F.col("estado") == M.STATE_STORED, F.lit(False)) & F.lit(permitted),
        }
    )


def distinct_products(tables: Tables) -> DataFrame:
    """Product names of the listing, once each, in the order they first appear in it.

    Pieces are reduced to one row per product before the names are joined. The
    listing does not say which of two pieces of the same moment comes first;
    here the names decide.
    """
    names = tables.producto.select("id_producto", F.col("nombre").alias("nombre_producto"))
    return (
        tables.pieza.groupBy("id_producto")
        .agg(F.max("fecha_registro").alias("_newest"))
        .join(names, "id_producto", "left")
        .groupBy("nombre_producto")
        .agg(F.max("_newest").alias("ultima_fecha"))
        .orderBy(F.desc("ultima_fecha"), "nombre_producto")
    )


def row_count(frame: DataFrame, name: str) -> DataFrame:
    """The number of rows of a result, and whether it is empty."""
    return frame.agg(F.count(F.lit(1)).alias("filas")).select(
        F.lit(name).alias("listado"), "filas", (F.col("filas") == 0).alias("vacio")
    )


def list_models(tables: Tables) -> DataFrame:
    return tables.dron.select("id", "nombre").orderBy("nombre", "id")
