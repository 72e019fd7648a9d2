"""Registering pieces.

The outcome equals handling the requests one at a time, in ``seq`` order:

1. An unknown supplier code needs a product name; the first request that has
   one creates the product. Requests before it are rejected, later ones find
   the product.
2. A serial that is known, or was taken by an earlier accepted request, is
   rejected. A product created by such a request stays.
3. Otherwise the piece is inserted as available, and journalled.

Both rules only need the earliest request per supplier code and per serial,
which are aggregations that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.ids import assign_ids
from stockroom.operators.joins import decide, lookup_join, only_asked, unseen
from stockroom.schemas import TABLES
from stockroom.sources.requests import complete_requests, incomplete_decisions
from stockroom.sources.tables import Tables
from stockroom.staging import staged


def register_form(requests: DataFrame) -> DataFrame:
    """What the entry form does first: trim, and demand serial, box, user and supplier code."""
    trimmed = requests.withColumns(
        {c: text.form_trim(F.col(c)) for c in ("codigo_original", "numero_serie", "caja")}
        | {
            c: F.nullif(text.form_trim(F.col(c)), F.lit(""))
            for c in ("nombre_producto", "descripcion_producto")
        }
    )
    missing = text.blank(F.col("numero_serie")) | text.blank(F.col("caja")) | F.col("id_usuario").isNull()
    return trimmed.select(
        "*",
        *decide(
            (missing, 400, M.FORM_MISSING),
            (text.blank(F.col("codigo_original")), 400, M.FORM_NO_SUPPLIER_CODE),
        ),
    )


def _supplier_codes(tables: Tables, requests: DataFrame) -> DataFrame:
    """Per supplier code of the batch: the product that has it, or the request that creates it."""
    named = text.given(F.col("nombre_producto"))
    asked = requests.groupBy("codigo_original").agg(F.min(F.when(named, F.col("seq"))).alias("_named"))
    held = only_asked(tables.producto, requests, "codigo_original")
    known = held.groupBy("codigo_original").agg(F.min("id_producto").alias("_known"))
    creator = F.when(F.col("_known").isNull(), F.col("_named"))
    return asked.join(known, "codigo_original", "left").select(
        "codigo_original", "_known", creator.alias("_creator")
    )


def _screened(tables: Tables, requests: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Requests with a flag: is there a product for the piece?"""
    codes = _supplier_codes(tables, requests) if codes is None else codes
    has_product = F.col("_known").isNotNull() | (F.col("seq") >= F.col("_creator"))
    rows = lookup_join(requests.select("seq", "codigo_original", "numero_serie"), codes, "codigo_original")
    return rows.select("seq", "numero_serie", F.coalesce(has_product, F.lit(False)).alias("_has_product"))


def _inserting(tables: Tables, requests: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``seq`` of the requests that insert a piece: the first for a serial that nobody has."""
    first = (
        _screened(tables, requests, codes)
        .where("_has_product")
        .groupBy("numero_serie")
        .agg(F.min("seq").alias("seq"))
    )
    return unseen(first, "numero_serie", tables.pieza, "numero_serie", asked=requests).select("seq")


def register_decisions(tables: Tables, requests: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``codes``: for each supplier code its product, or the request that creates it, if that is known already."""
    inserting = _inserting(tables, requests, codes).withColumn("_inserts", F.lit(True))
    return _screened(tables, requests, codes).select("seq", "_has_product").join(inserting, "seq", "left").select(
        "seq",
        *decide(
            (~F.col("_has_product"), 400, M.NAME_REQUIRED),
            (F.col("_inserts").isNull(), 400, M.SERIAL_KNOWN),
            done=M.REGISTERED,
        ),
    )


def register_validated(tables: Tables, requests: DataFrame) -> DataFrame:
    """Decisions on raw requests: 422 for those that leave out a field, the others as usual."""
    told = register_decisions(tables, complete_requests(requests, "register"))
    refused = incomplete_decisions(requests, "register")
    return told.unionByName(refused, allowMissingColumns=True)


def register_new_products(tables: Tables, requests: DataFrame) -> DataFrame:
    """Products the batch creates, with the request that created each."""
    return _new_products(tables, requests, _supplier_codes(tables, requests))


def _new_products(tables: Tables, requests: DataFrame, codes: DataFrame) -> DataFrame:
    creators = codes.where(F.col("_creator").isNotNull()).select(F.col("_creator").alias("seq"))
    created = requests.join(creators, "seq", "left_semi").select(
        "seq",
        "codigo_original",
        F.col("nombre_producto").alias("nombre"),
        F.col("descripcion_producto").alias("descripcion"),
        "id_dron",
        F.lit(None).cast("int").alias("stock_minimo"),
    )
    return assign_ids(created, "seq", tables.producto, "id_producto")


def unique_codes(
    rows: DataFrame, held: DataFrame, prefix: str = "INV", code: Callable[[Column, str, int], Column] = text.piece_code
) -> DataFrame:
    """``seq, codigo_barras`` for ``rows(seq, numero_serie)``: no code twice, none that ``held(codigo_barras)`` has.

    A code goes to the first row that wants it; the others hash their serial
    again. Two serials seldom want the same code, so one round is the rule.
    """
    settled: list[DataFrame] = []
    open_rows, attempt = rows.select("seq", "numero_serie"), 0
    while True:
        coded = open_rows.withColumn("codigo_barras", code(F.col("numero_serie"), prefix, attempt))
        taken = only_asked(held.select("codigo_barras"), coded, "codigo_barras").distinct()
        taken = reduce(DataFrame.unionByName, [taken, *(s.select("codigo_barras") for s in settled)])
        first = coded.groupBy("codigo_barras").agg(F.min("seq").alias("_first"))
        first = first.join(taken.withColumn("_taken", F.lit(True)), "codigo_barras", "left")
        free = F.col("_taken").isNull() & (F.col("seq") == F.col("_first"))
        judged = lookup_join(coded, first, "codigo_barras").select("seq", "numero_serie", "codigo_barras", free.alias("_free"))
        judged = staged(judged, "codes")
        settled.append(judged.where("_free").select("seq", "codigo_barras"))
        open_rows, attempt = judged.where("not _free").select("seq", "numero_serie"), attempt + 1
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def register_new_pieces(tables: Tables, requests: DataFrame, prefix: str = "INV") -> DataFrame:
    """Pieces the batch inserts, with the request that inserted each.

    The batch is screened once: what it inserts, and its codes, are written
    before they are used again.
    """
    codes = staged(_supplier_codes(tables, requests), "supplier_codes")
    created = _new_products(tables, requests, codes).select("codigo_original", F.col("id_producto").alias("_new"))
    products = codes.select("codigo_original", "_known").join(created, "codigo_original", "left").select(
        "codigo_original", F.coalesce("_known", "_new").alias("id_producto")
    )
    return new_pieces(tables, requests, codes, products, prefix)


def new_pieces(
    tables: Tables, requests: DataFrame, codes: DataFrame, products: DataFrame, prefix: str = "INV"
) -> DataFrame:
    """As ``register_new_pieces``, given ``products(codigo_original, id_producto)`` of the batch."""
    accepted = staged(requests.join(_inserting(tables, requests, codes), "seq", "left_semi"), "accepted")
    barcodes = unique_codes(accepted, tables.pieza, prefix)
    pieces = lookup_join(accepted, products, "codigo_original").join(barcodes, "seq").select(
        "seq",
        "id_producto",
        "numero_serie",
        "codigo_barras",
        F.lit(M.STATE_REGISTERED).alias("estado"),
        "id_usuario",
        "caja",
        F.col("ts").alias("fecha_registro"),
    )
    return assign_ids(pieces, "seq", tables.pieza, "id_pieza")


def register_movements(new_pieces: DataFrame) -> DataFrame:
    """Journal rows for inserted pieces."""
    return new_pieces.select(
        "seq",
        F.col("fecha_registro").alias("ts"),
        "id_pieza",
        F.lit(M.MOVE_REGISTERED).alias("tipo_movimiento"),
        F.lit(None).cast("string").alias("estado_anterior"),
        F.lit(M.STATE_REGISTERED).alias("estado_nuevo"),
        "id_usuario",
        F.lit(M.REGISTERED_NOTE).alias("observaciones"),
    )


def label_manifest(new_pieces: DataFrame, base_url: str) -> DataFrame:
    """The label of each inserted piece: code, picture path, absolute address, print date."""
    path = F.concat(F.lit("codigos/"), F.col("codigo_barras"), F.lit(".png"))
    base = F.regexp_replace(F.lit(base_url), "/+$", "")
    return new_pieces.select(
        "seq",
        "id_pieza",
        "codigo_barras",
        path.alias("ruta"),
        F.concat(base, F.lit("/"), path).alias("ruta_etiqueta"),
        text.label_date(F.col("fecha_registro")).alias("fecha_impresion"),
    )


def tables_after(tables: Tables, new_products: DataFrame, new_pieces: DataFrame) -> Tables:
    """The tables with the new rows appended."""
    return tables.with_(
        producto=tables.producto.unionByName(new_products.select(*TABLES["producto"].fieldNames())),
        pieza=tables.pieza.unionByName(new_pieces.select(*TABLES["pieza"].fieldNames())),
    )
