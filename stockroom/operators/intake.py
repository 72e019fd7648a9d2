"""Raw requests of one kind: 422 for those with fields of a wrong type, decisions on the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators import checkout, lookup, ownership, products, register, state, users
from stockroom.sources.requests import refused_decisions, sound_requests
from stockroom.sources.tables import Tables
from stockroom.staging import staged

#: What decides the requests of each kind; a scan is always answered.
DECIDE: dict[str, Callable[[Tables, DataFrame], DataFrame]] = {
    "scan": lambda t, r: lookup.scan_lookup(t, r).select(
        "seq", F.lit(True).alias("accepted"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("reason")
    ),
    "register": register.register_decisions,
    "status": state.status_decisions,
    "checkout": checkout.checkout_decisions,
    "create_product": lambda t, r: products.create_products_decisions(t, r, form=False),
    "create_user": users.create_users_decisions,
    "edit_user": lambda t, r: ownership.edit_users_exact(t.usuario, r),
    "toggle_user": users.toggle_users,
    "login": users.login_audit,
}


def raw_decisions(tables: Tables, parsed: DataFrame, kind: str) -> DataFrame:
    """``seq, accepted, status, reason`` for every line of ``parsed_requests``.

    The lines are parsed once: a condition on what parsing gives would otherwise
    take the parsing along to wherever it is checked.
    """
    parsed = staged(parsed.drop("raw"), "parsed")
    columns = ["seq", "accepted", "status", "reason"]
    decided = DECIDE[kind](tables, sound_requests(parsed, kind)).select(*columns)
    return decided.unionByName(refused_decisions(parsed))
