"""Requests of all kinds in one order.

``seq`` is unique over all kinds, and the outcome is that of handling every
request in this order: a piece registered by one request can be changed, or
taken out, by the next; a product made on the administration page serves the
registrations after it; a user made, renamed, promoted or switched off in the
batch is so for what follows.

Every request is a change of the state of a product, a piece or a user, and
what a request meets is the composition of the changes before it:

* products: a request that makes one waits for its key, the name on the
  administration page and the supplier code in a registration, and takes both.
  It makes the product if nobody took its key before.
* pieces: a change of state sets a constant; a checkout by an allowed user turns
  the required state into the state of what has left, and leaves any other as it
  is. So between two settings only the first allowed checkout counts.
* users: names and e-mails are decided exactly (``ownership``); roles are
  constants, switching is a parity.

A value as of a request is found by ranges of the order (``ordered``), so a key
with very many requests is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators import register
from stockroom.operators.greedy import BLOCK, first_in_component, settle_in_turn
from stockroom.operators.ids import assign_ids
from stockroom.operators.joins import decide, lookup_join, only_asked
from stockroom.operators.journal import movements_all
from stockroom.operators.ordered import previous_value, running_count
from stockroom.operators.ownership import UserOutcome, handle_user_requests
from stockroom.operators.snapshot import merge_changes
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources.tables import Tables
from stockroom.staging import staged

#: The kinds that change something; scans are looked up in the tables before or after a batch.
KINDS = ("register", "status", "checkout", "create_product", "create_user", "edit_user", "toggle_user", "login")


class Changes(NamedTuple):
    """What a batch adds to the tables, and then sets in them: one row per key, NULL leaves a value as it is."""

    new_products: DataFrame
    new_pieces: DataFrame
    new_users: DataFrame
    piece_patches: DataFrame
    user_patches: DataFrame

    def applied(self, tables: Tables) -> Tables:
        """The tables after the batch."""
        with_new = register.tables_after(tables, self.new_products, self.new_pieces)
        people = tables.usuario.select(*TABLES["usuario"].fieldNames())
        people = people.unionByName(self.new_users.select(*people.columns))
        return with_new.with_(
            usuario=merge_changes(people, self.user_patches, "id_usuario"),
            pieza=merge_changes(with_new.pieza, self.piece_patches, "id_pieza"),
        )


class Outcome(NamedTuple):
    """What a batch comes to."""

    decisions: DataFrame  # seq, tipo, accepted, status, reason, mensaje
    changes: Changes
    movements: DataFrame
    tables: Tables  # after the batch


def as_of(
    rows: DataFrame, changes: DataFrame, initial: DataFrame, key: str, name: str, ranges: int | None = None
) -> DataFrame:
    """Add the value that the key of a row has just before the row's ``seq``.

    ``changes(seq, key, value)`` set a value, never NULL; ``initial(key, value)`` has it before all changes.
    """
    marked = rows.select("*", F.lit(None).cast(changes.schema["value"].dataType).alias("value"), F.lit(True).alias("_asks"))
    every = marked.unionByName(changes.select("seq", key, "value", F.lit(False).alias("_asks")), allowMissingColumns=True)
    found = previous_value(every, key, "seq", F.col("value"), "_changed", ranges).where("_asks").drop("value", "_asks")
    asked = only_asked(initial, rows, key).select(key, F.col("value").alias("_initial"))
    return lookup_join(found, asked, key).withColumn(name, F.coalesce("_changed", "_initial")).drop("_changed", "_initial")


# --- products -----------------------------------------------------------------


def _makers(tables: Tables, made: DataFrame, registrations: DataFrame) -> DataFrame:
    """``seq, nombre, codigo_original`` of the requests that make a product."""
    by_name = made.select("seq", "nombre", "codigo_original", F.lit(True).alias("by_name"))
    named = registrations.where(text.given(F.col("nombre_producto")))
    by_code = named.select("seq", F.col("nombre_producto").alias("nombre"), "codigo_original", F.lit(False).alias("by_name"))
    # of the requests that wait for the same key only the first can win: it takes the key, unless that was taken before
    key = F.when(F.col("by_name"), F.col("nombre")).otherwise(F.col("codigo_original"))
    apart = F.when(key.isNull(), F.coalesce("nombre", "codigo_original"))
    rows = by_name.unionByName(by_code).groupBy("by_name", key.alias("_key"), apart.alias("_apart"))
    rows = rows.agg(F.min(F.struct("seq", "nombre", "codigo_original")).alias("_first")).select("by_name", "_first.*")
    rows = rows.join(only_asked(tables.producto, made, "nombre").select("nombre"), "nombre", "left_anti").where(
        "by_name"
    ).unionByName(
        rows.join(
            only_asked(tables.producto, registrations, "codigo_original").select("codigo_original"),
            "codigo_original", "left_anti",
        ).where("not by_name")
    )
    coded = staged(rows, "makers")
    for key, odd in (("nombre", 0), ("codigo_original", 1)):
        low = coded.groupBy(key).agg((F.min("seq") * 2 + odd).alias(f"_{key}"))
        coded = lookup_join(coded, low, key)
    waits = F.when(F.col("by_name"), F.col("_nombre")).otherwise(F.col("_codigo_original"))
    takes = F.array_compact(F.array("_nombre", "_codigo_original"))
    open_rows = staged(
        coded.select(
            "seq", "nombre", "codigo_original", F.col("seq").alias("owner"),
            F.array_compact(F.array(waits)).alias("needs"), takes.alias("takes"),
        ),
        "makers",
    )
    won: list[DataFrame] = []
    left = open_rows.count()
    while left:
        winners = open_rows.join(settle_in_turn(open_rows.select("seq", "owner", "needs", "takes"), left), "seq", "left_semi")
        winners = staged(winners, "winners")
        won.append(winners)
        if left <= BLOCK:
            break
        # the rest of each component: what waits for something taken before goes
        taken = winners.select(F.explode("takes").alias("_key"), F.col("seq").alias("_at"))
        taken = taken.groupBy("_key").agg(F.min("_at").alias("_at"))
        block = first_in_component(open_rows, F.array_union("needs", "takes"), BLOCK).select("seq")
        rest = open_rows.join(block, "seq", "left_anti").withColumn("_key", F.get("needs", F.lit(0)))
        rest = lookup_join(rest, taken, "_key").where(F.col("_at").isNull()).drop("_key", "_at")
        open_rows = staged(rest, "makers")
        left = open_rows.count()
    columns = ["seq", "nombre", "codigo_original"]
    return reduce(DataFrame.unionByName, [w.select(*columns) for w in won] or [open_rows.select(*columns)])


class Products(NamedTuple):
    """The products that a batch makes, and what its registrations find."""

    new: DataFrame  # seq and the columns of ``producto``
    codes: DataFrame  # codigo_original, _known, _creator, as registrations need them
    by_code: DataFrame  # codigo_original, id_producto


def _products(tables: Tables, made: DataFrame, registrations: DataFrame) -> Products:
    makers = staged(_makers(tables, made, registrations), "made")
    won = makers.select("seq")
    columns = ["seq", *(c for c in TABLES["producto"].fieldNames() if c != "id_producto")]
    by_form = made.join(won, "seq", "left_semi").select(*columns)
    by_registration = registrations.join(won, "seq", "left_semi").select(
        "seq", "codigo_original", F.col("nombre_producto").alias("nombre"),
        F.col("descripcion_producto").alias("descripcion"), "id_dron", F.lit(None).cast("int").alias("stock_minimo"),
    )
    new = staged(assign_ids(by_form.unionByName(by_registration), "seq", tables.producto, "id_producto"), "new_products")
    asked = registrations.select("codigo_original").distinct()
    held = only_asked(tables.producto, registrations, "codigo_original")
    known = held.groupBy("codigo_original").agg(F.min("id_producto").alias("_known"))
    first = new.groupBy("codigo_original").agg(F.min(F.struct("seq", "id_producto")).alias("_first"))
    codes = staged(asked.join(known, "codigo_original", "left").join(first, "codigo_original", "left"), "supplier_codes")
    creator = F.when(F.col("_known").isNull(), F.col("_first.seq"))
    return Products(
        new.select("seq", *TABLES["producto"].fieldNames()),
        codes.select("codigo_original", "_known", creator.alias("_creator")),
        codes.select("codigo_original", F.coalesce("_known", "_first.id_producto").alias("id_producto")),
    )


def _product_decisions(made: DataFrame, new: DataFrame) -> DataFrame:
    won = new.select("seq", F.lit(True).alias("_made"))
    return made.select("seq", "nombre").join(won, "seq", "left").select(
        "seq", *decide((F.col("_made").isNull(), 400, M.PRODUCT_CLASH), done=M.PRODUCT_CREATED)
    )


# --- users --------------------------------------------------------------------


class Timeline(NamedTuple):
    """Users over the batch."""

    since: DataFrame  # id_usuario, since: the request that made the user, NULL if there before
    roles: DataFrame  # seq, id_usuario, value
    initial_roles: DataFrame  # id_usuario, value
    switches: DataFrame  # seq, id_usuario, value: after accepted switches
    initial_active: DataFrame
    toggled: DataFrame  # decisions on switches, with id_usuario and activo


def _timeline(tables: Tables, outcome: UserOutcome, toggles: DataFrame) -> Timeline:
    nobody = F.lit(None).cast("bigint")
    old, new = tables.usuario, outcome.new_users
    since = old.select("id_usuario", nobody.alias("since")).unionByName(
        new.select("id_usuario", F.col("seq").alias("since"))
    )
    roles = outcome.patches.where(F.col("rol").isNotNull()).select("seq", "id_usuario", F.col("rol").alias("value"))
    both = old.select("id_usuario", "rol", "activo").unionByName(new.select("id_usuario", "rol", "activo"))
    active = both.select("id_usuario", F.coalesce("activo", F.lit(False)).alias("value"))
    there = _present(toggles, since)
    counted = running_count(there.where("_there").select("seq", "id_usuario"), "id_usuario", "seq", "_nth")
    flipped = lookup_join(counted, only_asked(active, toggles, "id_usuario"), "id_usuario")
    switched = staged(
        flipped.select("seq", "id_usuario", (F.col("value") != (F.col("_nth") % 2 == 1)).alias("value")), "switches"
    )
    told = there.join(switched.select("seq", F.col("value").alias("activo")), "seq", "left")
    told = told.withColumn("estado_texto", text.switched(F.col("activo"))).select(
        "seq", *decide((~F.col("_there"), 404, M.NO_USER), done=M.USER_SWITCHED)
    )
    initial_roles = both.select("id_usuario", F.col("rol").alias("value"))
    return Timeline(since, roles, initial_roles, switched, active, told)


def _present(rows: DataFrame, since: DataFrame, key: str = "id_usuario") -> DataFrame:
    """Add ``_there``: did what the row names exist by then?"""
    known = only_asked(since, rows, key).select(key, "since", F.lit(True).alias("_known"))
    there = F.col("_known").isNotNull() & (F.col("since").isNull() | (F.col("since") < F.col("seq")))
    return lookup_join(rows, known, key).withColumn("_there", there).drop("_known", "since")


def _name_holders(tables: Tables, outcome: UserOutcome, logins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who is found under a name: ``changes(seq, nombre_usuario, value)`` and ``initial(nombre_usuario, value)``.

    Only names that change hands have changes; each has one row per change. A value is a struct: nobody is a value too.
    """
    renamed = outcome.patches.where(F.col("nombre_usuario").isNotNull()).select("seq", "id_usuario", "nombre_usuario")
    moves = renamed.unionByName(outcome.new_users.select("seq", "id_usuario", "nombre_usuario"))
    # a name ends with the next name of the user; users with very many names are rare, and their rows few
    stays = staged(moves, "renames")
    follows = previous_value(
        stays.select((-F.col("seq")).alias("back"), "seq", "id_usuario", "nombre_usuario"),
        "id_usuario", "back", F.col("seq"), "until",
    ).select("nombre_usuario", "id_usuario", F.col("seq").alias("begin"), "until")
    first_move = stays.groupBy("id_usuario").agg(F.min("seq").alias("until"))
    old = tables.usuario.select("nombre_usuario", "id_usuario").join(first_move, "id_usuario", "left")
    old = old.select("nombre_usuario", "id_usuario", F.lit(-(1 << 62)).alias("begin"), "until")
    spans = staged(only_asked(old.unionByName(follows), logins, "nombre_usuario"), "spans")
    initial = spans.where(F.col("begin") < -(1 << 61)).groupBy("nombre_usuario").agg(F.min("id_usuario").alias("id"))
    initial = initial.select("nombre_usuario", F.struct("id").alias("value"))
    turns = spans.select("nombre_usuario", F.explode(F.array("begin", "until")).alias("seq"))
    turns = turns.where(F.col("seq") > -(1 << 61)).distinct()
    s, t = spans.alias("s"), turns.alias("t")
    covers = (F.col("s.begin") <= F.col("t.seq")) & (F.col("s.until").isNull() | (F.col("s.until") > F.col("t.seq")))
    holders = t.join(s, (F.col("s.nombre_usuario") == F.col("t.nombre_usuario"))).groupBy("t.seq", "t.nombre_usuario")
    changes = holders.agg(F.min(F.when(covers, F.col("s.id_usuario"))).alias("id"))
    return changes.select("seq", "nombre_usuario", F.struct("id").alias("value")), initial


def _login_decisions(tables: Tables, outcome: UserOutcome, timeline: Timeline, logins: DataFrame) -> DataFrame:
    changes, initial = _name_holders(tables, outcome, logins)
    found = as_of(logins, changes, initial, "nombre_usuario", "_holder")
    found = staged(found.withColumn("id_usuario", F.col("_holder.id")).drop("_holder"), "logins")
    told = as_of(found, timeline.switches, timeline.initial_active, "id_usuario", "_active")
    return told.select(
        "seq", "ts", "id_usuario",
        *decide(
            (F.col("id_usuario").isNull(), 401, M.BAD_LOGIN),
            (~F.coalesce("_active", F.lit(False)), 401, M.INACTIVE),
            (~F.coalesce("password_ok", F.lit(False)), 401, M.BAD_LOGIN),
        ),
    )


# --- pieces -------------------------------------------------------------------


class Pieces(NamedTuple):
    """Decisions on changes and checkouts, and their journal rows."""

    changed: DataFrame
    left: DataFrame
    movements: DataFrame


def _pieces(
    tables: Tables, new: DataFrame, timeline: Timeline, changes: DataFrame, checkouts: DataFrame,
    required_state: str, allowed_roles: Sequence[str],
) -> Pieces:
    nobody = F.lit(None).cast("bigint")
    since = tables.pieza.select("id_pieza", nobody.alias("since")).unionByName(
        new.select("id_pieza", F.col("seq").alias("since"))
    )
    start = tables.pieza.select("id_pieza", "estado").unionByName(new.select("id_pieza", "estado"))
    settable = F.coalesce(F.col("nuevo_estado").isin(M.STATES_SETTABLE), F.lit(False))
    changes = _present(changes, since, "id_pieza").withColumn("_settable", settable)
    checkouts = _present(checkouts, since, "id_pieza").withColumnRenamed("_there", "_piece")
    checkouts = _present(checkouts, timeline.since).withColumnRenamed("_there", "_user")
    checkouts = as_of(checkouts, timeline.roles, timeline.initial_roles, "id_usuario", "_role")
    passes = F.col("_piece") & F.col("_user") & F.coalesce(F.col("_role").isin(list(allowed_roles)), F.lit(False))
    checkouts = checkouts.withColumn("_passes", passes)
    asks = changes.withColumn("_leaves", F.lit(False)).unionByName(
        checkouts.withColumn("_leaves", F.lit(True)), allowMissingColumns=True
    )
    # the last setting before a request, and its place: requests between two settings share it
    value = F.struct(F.col("nuevo_estado").alias("estado"), F.col("seq").alias("at"))
    settings = changes.where(F.col("_there") & F.col("_settable")).select("seq", "id_pieza", value.alias("value"))
    initial = start.select("id_pieza", F.struct("estado", F.lit(None).cast("bigint").alias("at")).alias("value"))
    rows = staged(as_of(asks, settings, initial, "id_pieza", "_set"), "pieces")
    span = F.struct("id_pieza", F.coalesce("_set.at", F.lit(-(1 << 62))).alias("at"))
    rows = rows.withColumn("_span", span)
    fits = F.col("_leaves") & F.col("_passes") & F.coalesce(F.col("_set.estado") == required_state, F.lit(False))
    taken = rows.where(fits).groupBy("_span").agg(F.min("seq").alias("_taken"))
    rows = lookup_join(rows, taken, "_span")
    gone = F.coalesce(F.col("_taken") < F.col("seq"), F.lit(False))
    before = F.when(gone, F.lit(M.STATE_LEFT)).otherwise(F.col("_set.estado"))
    rows = staged(rows.withColumn("_before", before), "judged")
    changed = rows.where("not _leaves").select(
        "seq",
        *decide((~F.col("_settable"), 400, M.BAD_STATE), (~F.col("_there"), 404, M.NO_PIECE), done=M.STATE_SET),
    )
    stored = F.coalesce(F.col("_before") == required_state, F.lit(False))
    left = rows.where("_leaves").select(
        "seq",
        *decide(
            (~F.col("_piece"), 404, M.NO_PIECE),
            (~stored, 400, M.NOT_STORED),
            (~F.col("_user"), 404, M.NO_USER),
            (~F.col("_passes"), 403, M.CHECKOUT_DENIED),
            done=M.LEFT,
        ),
    )
    moved = rows.where((~F.col("_leaves") & F.col("_settable") & F.col("_there")) | (fits & (F.col("seq") == F.col("_taken"))))
    note = text.state_note(F.col("_before"), F.col("nuevo_estado"), F.col("observaciones"))
    kind = lambda a, b: F.when(F.col("_leaves"), a).otherwise(b)
    movements = moved.select(
        "seq", "ts", "id_pieza",
        kind(F.lit(M.MOVE_LEFT), F.lit(M.MOVE_STATE)).alias("tipo_movimiento"),
        F.col("_before").alias("estado_anterior"),
        kind(F.lit(M.STATE_LEFT), F.col("nuevo_estado")).alias("estado_nuevo"),
        "id_usuario",
        kind(F.coalesce("observaciones", F.lit("")), note).alias("observaciones"),
    )
    return Pieces(changed, left, movements)


# --- the batch ----------------------------------------------------------------


def _empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], REQUESTS[kind])


def _labelled(decisions: DataFrame, kind: str) -> DataFrame:
    columns = ["seq", "accepted", "status", "reason"]
    said = F.col("mensaje") if "mensaje" in decisions.columns else F.lit(None).cast("string")
    return decisions.select(*columns, said.alias("mensaje"), F.lit(kind).alias("tipo"))


def handle_batch(
    tables: Tables,
    requests: Mapping[str, DataFrame],
    required_state: str = M.STATE_STORED,
    allowed_roles: Sequence[str] = tuple(M.ROLES_CHECKOUT),
    prefix: str = "INV",
) -> Outcome:
    """Handle ``requests``, by kind, in the order of ``seq``.

    The checks are the server's; what an entry form refuses does not get here.
    """
    if unknown := set(requests) - set(KINDS):
        raise ValueError(f"kinds that change nothing: {sorted(unknown)}")
    spark = tables.usuario.sparkSession
    asked: dict[str, DataFrame] = {
        kind: requests[kind].select(*REQUESTS[kind].fieldNames()) if kind in requests else _empty(spark, kind)
        for kind in KINDS
    }
    registrations, made = asked["register"], asked["create_product"]
    products = _products(tables, made, registrations)
    pieces = staged(register.new_pieces(tables, registrations, products.codes, products.by_code, prefix), "new_pieces")
    users = handle_user_requests(tables.usuario, asked["create_user"], asked["edit_user"])
    timeline = _timeline(tables, users, asked["toggle_user"])
    logins = staged(_login_decisions(tables, users, timeline, asked["login"]), "logins")
    judged = _pieces(tables, pieces, timeline, asked["status"], asked["checkout"], required_state, allowed_roles)
    movements = movements_all(register.register_movements(pieces), judged.movements)
    decisions = {
        "register": register.register_decisions(tables, registrations, products.codes),
        "status": judged.changed,
        "checkout": judged.left,
        "create_product": _product_decisions(made, products.new),
        "create_user": users.created,
        "edit_user": users.edited,
        "toggle_user": timeline.toggled,
        "login": logins,
    }
    told = reduce(DataFrame.unionByName, (_labelled(rows, kind) for kind, rows in decisions.items()))
    changes = Changes(
        products.new, pieces, users.new_users, _last(judged.movements, "id_pieza", F.col("estado_nuevo"), "estado"),
        _user_patches(users, timeline, logins),
    )
    return Outcome(told, changes, movements, changes.applied(tables))


def _last(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.col("seq")).alias(name))


def _user_patches(users: UserOutcome, timeline: Timeline, logins: DataFrame) -> DataFrame:
    """Per user the last value of each field that edits, switches and logins set."""
    fields = ["nombre_usuario", "nombre_completo", "email", "rol", "activo", "ultimo_login"]
    switches = timeline.switches.select("seq", "id_usuario", F.col("value").alias("activo"))
    successes = logins.where("accepted").select("seq", "id_usuario", F.col("ts").alias("ultimo_login"))
    every = users.patches.unionByName(switches, allowMissingColumns=True).unionByName(successes, allowMissingColumns=True)
    return every.groupBy("id_usuario").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields))
