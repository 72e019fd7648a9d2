"""Creating products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.ids import assign_ids
from stockroom.operators.joins import decide, unseen
from stockroom.sources.tables import Tables

_TEXTS = ["codigo_original", "nombre", "descripcion"]


def _checked(requests: DataFrame, form: bool) -> DataFrame:
    if not form:
        return requests.withColumns({"_incomplete": F.lit(False), "_negative": F.lit(False)})
    rows = requests.withColumns({c: text.form_trim(F.col(c)) for c in _TEXTS})
    incomplete = F.col("id_dron").isNull() | F.col("stock_minimo").isNull()
    for name in _TEXTS:
        incomplete |= text.blank(F.col(name))
    return rows.withColumns({"_incomplete": incomplete, "_negative": F.col("stock_minimo") < 0})


def _creating(tables: Tables, checked: DataFrame) -> DataFrame:
    """``seq`` of the first request for each name no product has; supplier codes may repeat."""
    first = (
        checked.where("not _incomplete and not coalesce(_negative, false)")
        .groupBy("nombre")
        .agg(F.min("seq").alias("seq"))
    )
    return unseen(first, "nombre", tables.producto, "nombre").select("seq", F.lit(True).alias("_creates"))


def create_products_decisions(tables: Tables, requests: DataFrame, form: bool = True) -> DataFrame:
    """``form=False`` leaves out what the entry form checks before it sends a request."""
    checked = _checked(requests, form)
    creating = _creating(tables, checked)
    return checked.select("seq", "nombre", "_incomplete", "_negative").join(creating, "seq", "left").select(
        "seq",
        *decide(
            (F.col("_incomplete"), 400, M.FORM_INCOMPLETE),
            (F.col("_negative"), 400, M.FORM_NEGATIVE),
            (F.col("_creates").isNull(), 400, M.PRODUCT_CLASH),
            done=M.PRODUCT_CREATED,
        ),
    )


def create_products_new(tables: Tables, requests: DataFrame, form: bool = True) -> DataFrame:
    """Products the batch creates, with the request that created each."""
    checked = _checked(requests, form)
    created = checked.join(_creating(tables, checked), "seq", "left_semi")
    return assign_ids(
        created.select("seq", *_TEXTS, "id_dron", "stock_minimo"), "seq", tables.producto, "id_producto"
    )
