"""Low-stock alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.sources.sinks import write_lines
from stockroom.sources.tables import Tables


def low_stock_alerts(tables: Tables) -> DataFrame:
    """Products with fewer available pieces than their own minimum.

    Available pieces are counted per product before the join, so the shuffle
    carries one row per product and task, however often a product occurs. A
    product without any available piece counts zero; a minimum of NULL or zero
    raises no alert.
    """
    return alerts_from_counts(tables.producto, available_pieces(tables.pieza))


def available_pieces(pieces: DataFrame) -> DataFrame:
    """``id_producto, disponibles`` of every product with an available piece."""
    available = pieces.where(F.col("estado") == M.STATE_REGISTERED)
    return available.groupBy("id_producto").agg(F.count("id_pieza").alias("disponibles"))


def alerts_from_counts(products: DataFrame, available: DataFrame) -> DataFrame:
    """The alerts, given how many pieces of each product are available."""
    watched = products.where(F.col("stock_minimo") > 0).select("id_producto", "nombre", "stock_minimo")
    return (
        watched.join(available, "id_producto", "left")
        .withColumn("stock_actual", F.coalesce("disponibles", F.lit(0)))
        .where(F.col("stock_actual") < F.col("stock_minimo"))
        .select("id_producto", "nombre", "stock_minimo", "stock_actual")
    )


def low_stock_message(tables: Tables) -> DataFrame:
    """One line of text per alert, by product id."""
    line = F.concat(
        F.coalesce("nombre", F.lit("null")), F.lit(" quedan: "), F.col("stock_actual").cast("string")
    )
    return low_stock_alerts(tables).select("id_producto", line.alias("linea")).orderBy("id_producto")


def write_low_stock_message(tables: Tables, path: str) -> None:
    """The whole message as text files; the lines are joined by the files, not in one task."""
    write_lines(low_stock_message(tables), "linea", path)
