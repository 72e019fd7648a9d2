"""Checking pieces out of the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.operators.joins import decide, lookup_join, only_asked
from stockroom.operators.snapshot import merge_changes
from stockroom.sources.tables import Tables


def _screened(
    tables: Tables, requests: DataFrame, required_state: str, allowed_roles: Sequence[str]
) -> DataFrame:
    """Requests with the facts the checks need.

    Only the first request on a piece that passes all checks takes it out. A
    refused request changes nothing, and every later one meets the state check,
    which comes before the checks of the user.
    """
    pieces = only_asked(tables.pieza, requests, "id_pieza").select(
        "id_pieza", F.lit(True).alias("_piece"), F.col("estado").alias("_estado")
    )
    users = tables.usuario.select("id_usuario", F.lit(True).alias("_user"), "rol")
    rows = lookup_join(requests, pieces, "id_pieza").join(users, "id_usuario", "left")
    stored = F.coalesce(F.col("_estado") == required_state, F.lit(False))
    allowed = F.coalesce(F.col("rol").isin(list(allowed_roles)), F.lit(False))
    takes = _takes(tables, requests, required_state, allowed_roles)
    return lookup_join(rows.withColumns({"_stored": stored, "_allowed": allowed}), takes, "id_pieza")


def _takes(
    tables: Tables, requests: DataFrame, required_state: str, allowed_roles: Sequence[str]
) -> DataFrame:
    """Per piece, the request that takes it out; both filters reach the scans.

    Requests are reduced to one per piece before the pieces are joined.
    """
    stored = tables.pieza.where(F.col("estado") == required_state).select("id_pieza")
    allowed = tables.usuario.where(F.col("rol").isin(list(allowed_roles))).select("id_usuario")
    return (
        requests.select("seq", "id_pieza", "id_usuario")
        .join(allowed, "id_usuario", "left_semi")
        .groupBy("id_pieza")
        .agg(F.min("seq").alias("_taken_at"))
        .join(stored, "id_pieza")
    )


def checkout_decisions(
    tables: Tables,
    requests: DataFrame,
    required_state: str = M.STATE_STORED,
    allowed_roles: Sequence[str] = tuple(M.ROLES_CHECKOUT),
) -> DataFrame:
    rows = _screened(tables, requests, required_state, allowed_roles)
    gone = F.coalesce(F.col("_taken_at") < F.col("seq"), F.lit(False))
    return rows.select(
        "seq",
        *decide(
            (F.col("_piece").isNull(), 404, M.NO_PIECE),
            (~F.col("_stored") | gone, 400, M.NOT_STORED),
            (F.col("_user").isNull(), 404, M.NO_USER),
            (~F.col("_allowed"), 403, M.CHECKOUT_DENIED),
            done=M.LEFT,
        ),
    )


def checkout_movements(
    tables: Tables,
    requests: DataFrame,
    required_state: str = M.STATE_STORED,
    allowed_roles: Sequence[str] = tuple(M.ROLES_CHECKOUT),
) -> DataFrame:
    """Journal rows of the accepted requests."""
    rows = _screened(tables, requests, required_state, allowed_roles)
    return rows.where(F.col("seq") == F.col("_taken_at")).select(
        "seq",
        "ts",
        "id_pieza",
        F.lit(M.MOVE_LEFT).alias("tipo_movimiento"),
        F.col("_estado").alias("estado_anterior"),
        F.lit(M.STATE_LEFT).alias("estado_nuevo"),
        "id_usuario",
        F.coalesce("observaciones", F.lit("")).alias("observaciones"),
    )


def checkout_snapshot(tables: Tables, movements: DataFrame) -> DataFrame:
    """The pieces after the batch."""
    left = movements.select("id_pieza", F.col("estado_nuevo").alias("estado"))
    return merge_changes(tables.pieza, left, "id_pieza")
