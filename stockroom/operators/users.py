"""Users: listings, creation, edits, activation, logins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.greedy import first_come
from stockroom.operators.ids import assign_ids
from stockroom.operators.joins import decide, first_match, lookup_join, only_asked, unseen, with_existence
from stockroom.operators.ordered import running_count
from stockroom.operators.snapshot import merge_changes
from stockroom.schemas import TABLES
from stockroom.session import ensure_checkpoint_dir
from stockroom.sources.tables import Tables

_COLUMNS = TABLES["usuario"].fieldNames()

#: What two users must not share.
_UNIQUE = ["nombre_usuario", "email", "nombre_completo"]


# --- listings ---------------------------------------------------------------


def list_active_users(tables: Tables) -> DataFrame:
    return tables.usuario.where("activo").select(*_COLUMNS).orderBy(F.desc("id_usuario"))


def user_display(users: DataFrame) -> DataFrame:
    """Users as the administration page shows them."""
    return users.select(
        "id_usuario",
        text.first_given(F.col("nombre_completo"), M.DASH).alias("nombre_completo"),
        "nombre_usuario",
        "rol",
        text.last_login_text(F.col("ultimo_login")).alias("ultimo_login"),
        text.yes_no(F.col("activo")).alias("activo"),
        text.first_given(F.col("nombre_completo"), F.col("nombre_usuario"), M.NO_NAME).alias("nombre_mostrado"),
    )


def get_users(tables: Tables, asked: DataFrame) -> DataFrame:
    """One row per request for a user, with status 404 where there is none."""
    users = tables.usuario.select(*_COLUMNS, F.lit(True).alias("_found"))
    found = F.coalesce("_found", F.lit(False))
    return (
        asked.select("seq", "id_usuario")
        .join(users, "id_usuario", "left")
        .select("seq", *_COLUMNS, found.alias("encontrado"), F.when(found, 200).otherwise(404).alias("status"))
    )


# --- creation ---------------------------------------------------------------


def user_conflicts(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests that share a user name, an e-mail or a full name with a user.

    One semi join per key: a join on either of three equalities would compare
    every request with every user.
    """
    hits = reduce(
        DataFrame.unionByName,
        (
            requests.select("seq", key)
            .join(tables.usuario.select(key), key, "left_semi")
            .select("seq", F.lit(key).alias("_key"))
            for key in _UNIQUE
        ),
    )
    return hits.groupBy("seq").agg(
        *(F.bool_or(F.col("_key") == key).alias(f"choca_{key}") for key in _UNIQUE)
    )


def create_user_form(requests: DataFrame) -> DataFrame:
    """What the entry form does first: trim names and e-mail, and demand all three."""
    trimmed = requests.withColumns({c: text.form_trim(F.col(c)) for c in _UNIQUE})
    missing = reduce(lambda a, b: a | b, (text.blank(F.col(c)) for c in _UNIQUE))
    return trimmed.select("seq", *_UNIQUE, *decide((missing, 400, M.FORM_INCOMPLETE)))


def _accepted_users(tables: Tables, requests: DataFrame) -> DataFrame:
    """``seq`` of the requests that create a user.

    Copies of a request under all three keys share its fate or lose to it, so
    only the first is a contender.
    """
    contenders = (
        requests.where(text.email_ok(F.col("email"))).groupBy(*_UNIQUE).agg(F.min("seq").alias("seq"))
    )
    for key in _UNIQUE:
        contenders = unseen(contenders, key, tables.usuario, key, asked=requests)
    return first_come(contenders.withColumn("owner", F.col("seq")), _UNIQUE)


def create_users_decisions(tables: Tables, requests: DataFrame) -> DataFrame:
    """First come, first served under user name, e-mail and full name."""
    accepted = _accepted_users(tables, requests).withColumn("_accepted", F.lit(True))
    return requests.select("seq", "email").join(accepted, "seq", "left").select(
        "seq",
        *decide(
            (~text.email_ok(F.col("email")), 400, M.BAD_EMAIL),
            (F.col("_accepted").isNull(), 400, M.USER_CLASH),
        ),
    )


def create_users_new(tables: Tables, requests: DataFrame) -> DataFrame:
    """Users the batch creates, with the request that created each."""
    created = requests.join(_accepted_users(tables, requests), "seq", "left_semi").select(
        "seq",
        "nombre_usuario",
        "nombre_completo",
        "email",
        F.lit(M.ROLE_NEW_USER).alias("rol"),
        F.lit(True).alias("activo"),
        F.lit(None).cast("timestamp_ntz").alias("ultimo_login"),
    )
    numbered = assign_ids(created, "seq", tables.usuario, "id_usuario")
    return numbered.withColumn("mensaje", text.filled(M.USER_CREATED))


# --- edits ------------------------------------------------------------------

_EDITABLE = ["nombre_completo", "nombre_usuario", "email", "rol"]
_CLAIMS = ["_name", "_email"]


def _with_current(tables: Tables, requests: DataFrame) -> DataFrame:
    current = tables.usuario.select(
        "id_usuario", *(F.col(c).alias(f"_now_{c}") for c in _EDITABLE), F.lit(True).alias("_found")
    )
    return requests.join(current, "id_usuario", "left")


def edit_form(tables: Tables, requests: DataFrame, actor: int) -> DataFrame:
    """What the edit form does first: all fields filled, its own e-mail rule, own role untouched.

    Adds the decision, and reduces the fields to those that change.
    """
    rows = _with_current(tables, requests).withColumns(
        {c: text.form_trim(F.col(c)) for c in ("nombre_completo", "nombre_usuario", "email")}
    )
    changed = {c: ~F.col(c).eqNullSafe(F.col(f"_now_{c}")) for c in _EDITABLE}
    own_role = (F.col("id_usuario") == actor) & changed["rol"]
    none = ~reduce(lambda a, b: a | b, changed.values())
    checks = decide(
        (F.col("_found").isNull(), 404, M.NO_USER),
        (text.blank(F.col("nombre_completo")), 400, M.FORM_NAME_REQUIRED),
        (text.blank(F.col("nombre_usuario")), 400, M.FORM_USER_REQUIRED),
        (text.blank(F.col("email")), 400, M.FORM_EMAIL_REQUIRED),
        (~text.email_ok(F.col("email"), form=True), 400, M.FORM_BAD_EMAIL),
        (own_role, 400, M.FORM_OWN_ROLE),
        (none, 400, M.FORM_UNCHANGED),
    )
    patch = [F.when(changed[c], F.col(c)).alias(c) for c in _EDITABLE]
    return rows.select("seq", "id_usuario", *patch, *checks)


def _screened_edits(tables: Tables, requests: DataFrame) -> DataFrame:
    """Edits with the facts the checks need; a claim is a new, non-empty name or e-mail."""
    rows = _with_current(tables, requests)
    for claim, column in zip(_CLAIMS, ("nombre_usuario", "email")):
        new = text.given(F.col(column)) & ~F.col(column).eqNullSafe(F.col(f"_now_{column}"))
        rows = rows.withColumn(claim, F.when(F.col("_found") & new, F.col(column)))
    for claim, column in zip(_CLAIMS, ("nombre_usuario", "email")):
        rows = with_existence(rows, claim, tables.usuario, column, f"{claim}_held")
    bad_role = text.given(F.col("rol")) & ~F.col("rol").isin(M.ROLES_ADMIN)
    empty = F.coalesce(*(F.col(c) for c in _EDITABLE)).isNull()
    claims = F.struct(F.col("id_usuario").alias("owner"), *_CLAIMS)
    contends = (
        F.col("_found") & ~bad_role & ~empty & ~F.col("_name_held") & ~F.col("_email_held")
    )
    return rows.select(
        "seq", "id_usuario", *_EDITABLE, "_found",
        bad_role.alias("_bad_role"),
        empty.alias("_empty"),
        (F.col("_name_held") | F.col("_email_held")).alias("_held"),
        F.when(
            contends & (F.col("_name").isNotNull() | F.col("_email").isNotNull()), claims
        ).alias("_claims"),
    )


def _decided_edits(tables: Tables, requests: DataFrame) -> DataFrame:
    """Edits with ``_lost``: was a claimed value taken by an earlier edit of another user?

    Edits of one user that claim the same values stand or fall together, so
    each such group contends once, at its first ``seq``. The rows are needed for
    the contest and for the decisions, so they are computed once.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    rows = _screened_edits(tables, requests).checkpoint()
    groups = rows.where(F.col("_claims").isNotNull()).groupBy("_claims").agg(F.min("seq").alias("seq"))
    won = first_come(groups.select("seq", "_claims.*"), _CLAIMS)
    winners = groups.join(won, "seq", "left_semi").select("_claims", F.lit(True).alias("_won"))
    return lookup_join(rows, winners, "_claims").withColumn(
        "_lost", F.col("_claims").isNotNull() & F.col("_won").isNull()
    )


def _edit_checks():
    return decide(
        (F.col("_found").isNull(), 404, M.NO_USER),
        (F.col("_bad_role"), 400, M.BAD_ROLE),
        (F.col("_held") | F.col("_lost"), 400, M.EDIT_CLASH),
        (F.col("_empty"), 400, M.EDIT_EMPTY),
        done=M.USER_EDITED,
    )


def edit_users_decisions(tables: Tables, requests: DataFrame) -> DataFrame:
    """Decide edits against the users as they are when the batch starts.

    A value given up by one edit of the batch is free from the next batch on;
    new values go to the first user that claims them. A batch in which no edit
    claims a value that another one gives up has the outcome of handling its
    edits one at a time, and so has every batch of one.
    """
    return _decided_edits(tables, requests).select("seq", *_edit_checks())


def edit_users_snapshot(tables: Tables, requests: DataFrame) -> DataFrame:
    """The users after the batch: per user and field the last accepted value."""
    accepted = _decided_edits(tables, requests).select("seq", "id_usuario", *_EDITABLE, *_edit_checks())
    patches = (
        accepted.where("accepted")
        .groupBy("id_usuario")
        .agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in _EDITABLE))
    )
    return merge_changes(tables.usuario, patches, "id_usuario").select(*_COLUMNS)


# --- activation -------------------------------------------------------------


def _starts_active():
    return F.coalesce("activo", F.lit(False))


def toggle_users(tables: Tables, requests: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each request flips its user; ``activo`` is what the user is after the request."""
    counted = running_count(requests.select("seq", "id_usuario"), "id_usuario", "seq", "_nth", ranges)
    users = tables.usuario.select("id_usuario", "activo", F.lit(True).alias("_found"))
    after = F.when(F.col("_found"), _starts_active() != (F.col("_nth") % 2 == 1))
    return (
        counted.join(users, "id_usuario", "left")
        .withColumn("activo", after)
        .withColumn("estado_texto", text.switched(F.col("activo")))
        .select(
            "seq", *decide((F.col("_found").isNull(), 404, M.NO_USER), done=M.USER_SWITCHED), "activo"
        )
    )


def toggle_snapshot(tables: Tables, requests: DataFrame) -> DataFrame:
    """The users after the batch: an odd number of requests flips a user."""
    flips = requests.groupBy("id_usuario").agg((F.count(F.lit(1)) % 2 == 1).alias("_flip"))
    after = F.when(F.col("_flip").isNull(), F.col("activo")).otherwise(_starts_active() != F.col("_flip"))
    return (
        tables.usuario.join(flips, "id_usuario", "left").withColumn("activo", after).select(*_COLUMNS)
    )


# --- logins -----------------------------------------------------------------


def _users_by_name(tables: Tables, attempts: DataFrame) -> DataFrame:
    asked = only_asked(tables.usuario, attempts, "nombre_usuario")
    return first_match(asked, "nombre_usuario", "id_usuario", ["id_usuario", "rol", "activo"])


def login_audit(tables: Tables, attempts: DataFrame) -> DataFrame:
    """Unknown, inactive, wrong password, in this order; the first and last share a text."""
    rows = lookup_join(attempts, _users_by_name(tables, attempts), "nombre_usuario")
    return rows.select(
        "seq",
        *decide(
            (F.col("id_usuario").isNull(), 401, M.BAD_LOGIN),
            (~_starts_active(), 401, M.INACTIVE),
            (~F.coalesce("password_ok", F.lit(False)), 401, M.BAD_LOGIN),
        ),
        "id_usuario",
        "nombre_usuario",
        "rol",
    ).select(
        "seq", "accepted", "status", "reason",
        *(F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("id_usuario", "nombre_usuario", "rol")),
    )


def last_login(tables: Tables, attempts: DataFrame) -> DataFrame:
    """Time of the latest success per user; attempts are reduced before the users are joined."""
    latest = (
        attempts.where("password_ok").groupBy("nombre_usuario").agg(F.max("ts").alias("ultimo_login"))
    )
    users = _users_by_name(tables, attempts).where("activo").select("nombre_usuario", "id_usuario")
    return latest.join(users, "nombre_usuario").select("id_usuario", "ultimo_login")


def last_login_snapshot(tables: Tables, attempts: DataFrame) -> DataFrame:
    return merge_changes(tables.usuario, last_login(tables, attempts), "id_usuario").select(*_COLUMNS)
