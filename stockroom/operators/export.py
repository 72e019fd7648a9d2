"""The formatted export of available pieces."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.listing import joined_pieces, newest_first
from stockroom.sources.sinks import write_csv_rows
from stockroom.sources.tables import Tables


def _available(tables: Tables) -> DataFrame:
    stocked = tables.pieza.where(F.col("estado") == M.STATE_REGISTERED)
    return joined_pieces(tables.with_(pieza=stocked)).withColumn("usuario_nombre", F.col("nombre_usuario"))


def _as_text(rows: DataFrame) -> DataFrame:
    """Nine text columns under their headings; NULL gives an empty text."""
    return rows.select(
        *(
            (
                text.export_date(F.col(name)) if name == "fecha_registro" else text.export_text(F.col(name))
            ).alias(heading)
            for name, heading in M.EXPORT_HEADINGS.items()
        )
    )


def export_inventory(tables: Tables) -> DataFrame:
    """Available pieces, newest first; a missing user gives an empty text here."""
    return _as_text(_available(tables).orderBy(*newest_first()))


def column_width_profile(tables: Tables) -> DataFrame:
    """Display width per column of the export: the longest text plus padding, capped."""
    headings = list(M.EXPORT_HEADINGS.values())
    cells = _as_text(_available(tables))
    longest = cells.agg(*(F.max(F.length(F.col(h))).alias(h) for h in headings))
    widths = longest.select(
        *(
            F.least(
                F.greatest(F.coalesce(F.col(h), F.lit(0)), F.lit(len(h))) + M.EXPORT_WIDTH_PAD,
                F.lit(M.EXPORT_WIDTH_MAX),
            ).alias(h)
            for h in headings
        )
    )
    return widths.unpivot([], headings, "columna", "ancho")


def export_folder(root: str, at: datetime) -> str:
    return f"{root}/inventario_{at:%Y%m%d_%H%M%S}"


def write_export(tables: Tables, root: str, at: datetime) -> str:
    """Write the export and its width profile from the executors; part files are in order."""
    folder = export_folder(root, at)
    write_csv_rows(export_inventory(tables), f"{folder}/datos")
    write_csv_rows(column_width_profile(tables), f"{folder}/anchos")
    return folder
