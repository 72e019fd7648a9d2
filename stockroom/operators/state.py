"""Changing the state of pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.joins import decide, lookup_join, only_asked
from stockroom.operators.ordered import previous_value
from stockroom.operators.snapshot import merge_changes
from stockroom.sources.tables import Tables


def _settable():
    return F.coalesce(F.col("nuevo_estado").isin(M.STATES_SETTABLE), F.lit(False))


def _current(tables: Tables, rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows with the state of their piece in the snapshot."""
    known = only_asked(tables.pieza, requests, "id_pieza").select(
        "id_pieza", F.col("estado").alias("_estado"), F.lit(True).alias("_known")
    )
    return lookup_join(rows, known, "id_pieza")


def status_decisions(tables: Tables, requests: DataFrame) -> DataFrame:
    """An unknown state is refused before the piece is looked up; any valid change is accepted."""
    rows = _current(tables, requests.select("seq", "id_pieza", "nuevo_estado"), requests)
    return rows.select(
        "seq",
        *decide(
            (~_settable(), 400, M.BAD_STATE),
            (F.col("_known").isNull(), 404, M.NO_PIECE),
            done=M.STATE_SET,
        ),
    )


def status_movements(tables: Tables, requests: DataFrame, ranges: int | None = None) -> DataFrame:
    """Journal rows of the accepted changes, each with the state it replaced.

    That is the state set by the previous accepted change of the piece, or the
    state in the snapshot. Earlier changes are found before the pieces are
    joined, so a piece with very many changes stays split.
    """
    changes = requests.where(_settable())
    changes = previous_value(changes, "id_pieza", "seq", F.col("nuevo_estado"), "_previous", ranges)
    before = F.coalesce("_previous", "_estado")
    return (
        _current(tables, changes, requests)
        .where(F.col("_known"))
        .select(
            "seq",
            "ts",
            "id_pieza",
            F.lit(M.MOVE_STATE).alias("tipo_movimiento"),
            before.alias("estado_anterior"),
            F.col("nuevo_estado").alias("estado_nuevo"),
            "id_usuario",
            text.state_note(before, F.col("nuevo_estado"), F.col("observaciones")).alias("observaciones"),
        )
    )


def last_states(requests: DataFrame, validate: bool = True) -> DataFrame:
    """The state each piece ends in: that of its last change."""
    changes = requests.where(_settable()) if validate else requests
    return changes.groupBy("id_pieza").agg(F.max_by("nuevo_estado", "seq").alias("estado"))


def status_snapshot(tables: Tables, requests: DataFrame, validate: bool = True) -> DataFrame:
    """The pieces after the batch. ``validate=False`` sets any state, as the bare update does."""
    return merge_changes(tables.pieza, last_states(requests, validate), "id_pieza")


def live_status(requests: DataFrame) -> DataFrame:
    """State of each piece as known from its accepted changes alone, by time and then ``seq``."""
    return (
        requests.where(_settable())
        .groupBy("id_pieza")
        .agg(
            F.max_by("nuevo_estado", F.struct("ts", "seq")).alias("estado"),
            F.max("ts").alias("actualizado"),
            F.count(F.lit(1)).alias("cambios"),
        )
    )
