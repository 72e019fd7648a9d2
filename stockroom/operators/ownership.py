"""New users and edits of users, with the exact outcome of handling them one at a time.

Whether an edit is accepted depends on who holds a name or an e-mail at that
moment, and so on whether the edit that would have given it up was accepted.
The requests are linked through the users and values that they name. A
component of linked requests depends on no other, so all components are decided
at once, each in the order of receipt in one task, ``BLOCK`` requests at a time:
a larger component takes one step per ``BLOCK``. Components are found once, over
all that the requests name, and every row is written to the step that decides
it. The state of a user or value, as the tables have it, goes to the first step
that names it, and each step hands it on to the next one that does. So a step
reads its own requests and what they name, and all steps together read every
request once; a task holds no more than that.

Of more than ``BLOCK`` requests those are taken out first whose outcome shows
without a replay (``_foreseen``).

Ids of new users follow the last id in the order of acceptance. Where an edit
names an id after the last one, whom it means depends on all new users before,
so these requests form one component.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators.greedy import CONTRACT_FROM, placed_in_component, unopposed
from stockroom.operators.ids import assign_ids
from stockroom.operators.joins import _binary, decide, lookup_join, only_asked
from stockroom.schemas import TABLES
from stockroom.shipping import ship_package
from stockroom.staging import new_folder, staged

#: Requests of a component that one task decides in one step.
BLOCK = 100_000

_COLUMNS = TABLES["usuario"].fieldNames()
#: What two users must not share; an edit does not check the last one.
FIELDS = ["nombre_usuario", "email", "nombre_completo"]
_EDITABLE = [*FIELDS, "rol"]


class UserOutcome(NamedTuple):
    """What a batch of user requests comes to."""

    created: DataFrame  # seq, accepted, status, reason of the new users asked for
    edited: DataFrame  # seq, accepted, status, reason, mensaje of the edits
    new_users: DataFrame  # seq and the columns of ``usuario``, as created
    patches: DataFrame  # seq, id_usuario and what accepted edits set
    users: DataFrame  # the table after the batch


def _unpivoted(rows: DataFrame, *kept: str) -> DataFrame:
    """``*kept, field, value`` for each unique column that is not NULL."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("value")) for k, c in enumerate(FIELDS)))
    return rows.select(*kept, F.explode(pairs).alias("_p")).select(*kept, "_p.*").where("value is not null")


def _request_rows(creates: DataFrame, edits: DataFrame, users: DataFrame, last: int) -> DataFrame:
    """Requests whose outcome depends on others: ``seq, new, id_usuario, *FIELDS``."""
    contenders = creates.where(text.email_ok(F.col("email"))).select(
        "seq", F.lit(True).alias("new"), F.lit(None).cast("bigint").alias("id_usuario"), *FIELDS
    )
    known = only_asked(users, edits, "id_usuario").select("id_usuario", F.lit(True).alias("_known"))
    bad_role = text.given(F.col("rol")) & ~F.col("rol").isin(M.ROLES_ADMIN)
    empty = F.coalesce(*_EDITABLE).isNull()
    possible = F.col("_known").isNotNull() | (F.col("id_usuario") > last)
    names = F.coalesce(*FIELDS).isNotNull() | F.col("_known").isNull()
    changing = lookup_join(edits, known, "id_usuario").where(possible & ~bad_role & ~empty & names)
    return contenders.unionByName(changing.select("seq", F.lit(False).alias("new"), "id_usuario", *FIELDS))


def _linked(rows: DataFrame, users: DataFrame, last: int) -> DataFrame:
    """The rows with ``nodes``: numbers for the user and for the values that somebody asks for."""
    given = _unpivoted(rows, "seq", "new").where(F.col("new") | ((F.col("field") < 2) & (F.col("value") != "")))
    asked = given.select("field", "value").distinct()
    value_node = F.xxhash64("field", "value")
    values = _unpivoted(rows, "seq").join(asked, ["field", "value"], "left_semi").select("seq", value_node.alias("node"))
    user_node = F.xxhash64(F.lit("user"), "id_usuario")
    touched = rows.where("not new").select("id_usuario").distinct()
    # what a user holds already goes with the first request for that user
    held = _unpivoted(users.join(touched, "id_usuario", "left_semi"), "id_usuario")
    held = held.join(asked, ["field", "value"], "left_semi").select("id_usuario", value_node.alias("node"))
    first = rows.where("not new").groupBy("id_usuario").agg(F.min("seq").alias("seq"))
    nodes = values.unionByName(rows.where("not new").select("seq", user_node.alias("node")))
    nodes = nodes.unionByName(held.join(first, "id_usuario").select("seq", "node"))
    late = F.col("id_usuario") > last
    if not rows.where(late).isEmpty():
        nodes = nodes.unionByName(rows.where(F.col("new") | late).select("seq", F.xxhash64(F.lit("new")).alias("node")))
    by_row = nodes.groupBy("seq").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return rows.join(by_row, "seq", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<bigint>")))


#: What a task reads beside requests, and hands on: how many users hold a value, or (field -1) what a user holds.
_STATE = (
    "component bigint, at int, field int, value string, n bigint, later array<int>, "
    "own array<string>, own_later array<array<int>>"
)
#: Requests are told of in rows of their own.
_TOLD = "seq bigint, accepted boolean, id_usuario bigint, new boolean"
_USER = -1
#: Where rows go that are for no step: outcomes, new users whose next step is to be found, and those that have none.
_OUTCOME, _UNROUTED, _NOWHERE = -1, -2, -3
_OUT = pa.schema([
    ("component", pa.int64()), ("at", pa.int32()), ("field", pa.int32()), ("value", pa.string()), ("n", pa.int64()),
    ("later", pa.list_(pa.int32())), ("own", pa.list_(pa.string())), ("own_later", pa.list_(pa.list_(pa.int32()))),
    ("seq", pa.int64()), ("accepted", pa.bool_()), ("id_usuario", pa.int64()), ("new", pa.bool_()),
])


def _in_turn(step: int, next_id: int):
    """Decide the requests of a component in one step; what they name comes in rows with a ``field``."""

    def columns(table: pa.Table, *names: str):
        return zip(*(table.column(c).to_pylist() for c in names), strict=True)

    def run(table: pa.Table) -> pa.Table:
        component = table.column("component")[0].as_py()
        is_state = pc.is_valid(table.column("field"))
        holders, now, later, users_later = Counter(), {}, {}, {}
        own_later: dict[tuple[int, str], list[int]] = {}
        for field, value, n, lists in columns(table.filter(is_state), "field", "value", "n", "lists"):
            lists = json.loads(lists)
            steps = lists["later"]
            if field == _USER:
                own, theirs = lists["own"], lists["own_later"]
                now[int(value)], users_later[int(value)] = own, steps
                own_later.update(((k, v), t) for k, (v, t) in enumerate(zip(own, theirs, strict=True)) if t)
            else:
                holders[field, value] += n
                later[field, value] = steps
        out, made, following = [], [], next_id
        accepted, who = [], []
        requests = table.filter(pc.invert(is_state)).sort_by("seq")
        for seq, new, user, *given in columns(requests, "seq", "new", "id_usuario", *FIELDS):
            if new:
                fits = True
                for k, v in enumerate(given):
                    if v is not None and holders[k, v]:
                        fits = False
                        break
                if fits:
                    user, following = following, following + 1
                    now[user] = [None] * len(FIELDS)
                    made.append(user)
            else:
                own = now.get(user)
                fits = own is not None and not any(
                    given[k] and given[k] != own[k] and holders[k, given[k]] for k in range(2)
                )
            if fits:
                for k, value in enumerate(given):
                    if value is not None:
                        holders[k, now[user][k]] -= 1
                        holders[k, value] += 1
                        now[user][k] = value
            accepted.append(fits)
            who.append(user if user in now else None)

        def follow(key: tuple[int, str]) -> list[int]:
            """The later steps that name a value."""
            return later[key] if key in later else [s for s in own_later.get(key, ()) if s > step]

        for key, n in holders.items():
            steps = follow(key)
            if steps and (n or key in later):
                out.append({"at": steps[0], "field": key[0], "value": key[1], "n": n, "later": steps[1:]})
        for user in [*users_later, *(u for u in made if u not in users_later)]:
            steps = users_later.get(user, [_UNROUTED])
            if steps:
                theirs = [follow((k, v)) for k, v in enumerate(now[user])]
                out.append({
                    "at": steps[0], "field": _USER, "value": str(user), "later": steps[1:],
                    "own": now[user], "own_later": theirs,
                })
        told = {
            "at": pa.repeat(pa.scalar(_OUTCOME, pa.int32()), len(accepted)), "seq": requests.column("seq"),
            "accepted": accepted, "id_usuario": pa.array(who, pa.int64()), "new": requests.column("new"),
            "component": requests.column("component"),
        }
        told = pa.table([told.get(f.name, pa.nulls(len(accepted), f.type)) for f in _OUT], schema=_OUT)
        state = pa.Table.from_pylist([r | {"component": component} for r in out], schema=_OUT)
        return pa.concat_tables([told, state])

    return run


def _schedule(rows: DataFrame) -> DataFrame:
    """``component, field, value, steps``: in which steps a user, or a value that somebody asks for, is named."""
    given = _unpivoted(rows, "component", "step", "new")
    asked = given.where(F.col("new") | ((F.col("field") < 2) & (F.col("value") != "")))
    asked = asked.select("field", "value").distinct()
    values = given.join(asked, ["field", "value"], "left_semi").select("component", "step", "field", "value")
    named = rows.where("not new").select(
        "component", "step", F.lit(_USER).alias("field"), F.col("id_usuario").cast("string").alias("value")
    )
    by_key = values.unionByName(named).groupBy("component", "field", "value")
    return by_key.agg(F.sort_array(F.collect_set("step")).alias("steps"))


def _first_state(schedule: DataFrame, users: DataFrame) -> DataFrame:
    """What the tables say of everything named, for the first step that names it."""
    values = schedule.where(F.col("field") != _USER)
    held = _unpivoted(users).join(values.select("field", "value").distinct(), ["field", "value"], "left_semi")
    held = held.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    at, later = F.col("steps")[0].alias("at"), F.slice("steps", 2, F.size("steps")).alias("later")
    counted = values.join(held, ["field", "value"], "left").select(
        "component", at, "field", "value", F.coalesce("n", F.lit(0)).alias("n"), later
    )
    named = schedule.where(F.col("field") == _USER).select("component", "value", at, later)
    people = named.join(users.select(F.col("id_usuario").cast("string").alias("value"), *FIELDS), "value")
    for k, field in enumerate(FIELDS):
        steps = values.where(F.col("field") == k).select("component", F.col("value").alias(field), F.col("steps").alias(f"_{k}"))
        people = people.join(steps, ["component", field], "left")
    theirs = [F.coalesce(f"_{k}", F.array().cast("array<int>")) for k in range(len(FIELDS))]
    people = people.select(
        "component", "at", F.lit(_USER).alias("field"), "value", "later",
        F.array(*FIELDS).alias("own"), F.array(*theirs).alias("own_later"),
    )
    return counted.unionByName(people, allowMissingColumns=True)


def _read_step(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in columns), F.lit(False))


def _judged_by_tables(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The rows with ``lost``: a user whom nobody edits has what they ask for, and ``shaky``: one that is edited has it."""
    touched = rows.where("not new").select("id_usuario").distinct().withColumn("_edited", F.lit(True))
    people = users.join(touched, "id_usuario", "left").withColumn("_edited", F.col("_edited").isNotNull())
    for k, field in enumerate(FIELDS):
        held = people.where(F.col(field).isNotNull()).groupBy(field)
        held = held.agg(F.bool_or(~F.col("_edited")).alias(f"_kept_{k}"), F.bool_or("_edited").alias(f"_loose_{k}"))
        rows = lookup_join(rows, held, field)
    kept, loose = ([F.col(f"_{name}_{k}") for k in range(len(FIELDS))] for name in ("kept", "loose"))
    # where one that is edited has it too, an edit may ask for what the user has already
    refused = _any(kept[k] & ~loose[k] & (F.col(FIELDS[k]) != "") for k in range(2))
    lost = F.when(F.col("new"), _any(kept)).otherwise(refused)
    return rows.select("seq", "new", "id_usuario", *FIELDS, lost.alias("lost"), _any(loose).alias("shaky"))


def _foreseen(rows: DataFrame, users: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Decisions that need no replay, ``seq, accepted``, and the rows that are left; no row names a user made by another.

    What a user has whom no request edits is never given up. So an edit that asks
    for it fails, as does a new user. A value that no edited user has, and that no
    edit gives, is lost for good with the first new user that is accepted: of new
    users that ask for such values only, one that is the earliest under each is
    accepted, and later ones that ask for one of its values are not. An edit of
    the full name alone is accepted; it matters to others only if a new user asks
    for a full name that this user has or gets.
    """
    judged = staged(_judged_by_tables(rows, users), "judged_users")
    settled = [judged.where("lost").select("seq", F.lit(False).alias("accepted"))]
    edits = judged.where("not lost and not new")
    claims = judged.where("not lost and new")
    repeated = claims.groupBy("seq").count().where("count > 1").select("seq", F.lit(True).alias("_again"))
    claims = claims.join(repeated, "seq", "left")
    for k, field in enumerate(FIELDS):
        given = edits.where(F.col(field).isNotNull()).select(field).distinct().withColumn(f"_given_{k}", F.lit(True))
        claims = lookup_join(claims, given, field)
    shaky = _any([F.col("shaky"), F.col("_again"), *(F.col(f"_given_{k}") for k in range(len(FIELDS)))])
    claims = staged(claims.select("seq", (~shaky).alias("firm"), *FIELDS), "claims")
    for _ in range(CONTRACT_FROM):
        winners = staged(unopposed(claims, FIELDS).where("firm"), "unopposed")
        if winners.isEmpty():
            break
        told, foreign, own = claims, [], [F.coalesce(*FIELDS).isNull()]
        for k, field in enumerate(FIELDS):
            owned = winners.where(F.col(field).isNotNull()).select(field, F.col("seq").alias(f"_by_{k}"))
            told = lookup_join(told, owned, field)
            foreign.append(F.col(f"_by_{k}") != F.col("seq"))
            own.append(F.col(f"_by_{k}") == F.col("seq"))
        verdict = F.when(_any(foreign), F.lit(False)).when(F.col("firm") & _any(own), F.lit(True))
        told = staged(told.select("seq", "firm", *FIELDS, verdict.alias("accepted")), "claims")
        settled.append(told.where("accepted is not null").select("seq", "accepted"))
        claims = told.where("accepted is null").drop("accepted")
        if claims.count() <= most:
            break
    asked = claims.where("nombre_completo is not null").select("nombre_completo").distinct()
    mattering = users.unionByName(edits, allowMissingColumns=True).join(asked, "nombre_completo", "left_semi")
    mattering = mattering.select("id_usuario").distinct().withColumn("_matters", F.lit(True))
    alone = F.coalesce(*FIELDS[:2]).isNull() & F.col("_matters").isNull()
    edits = staged(lookup_join(edits, mattering, "id_usuario").withColumn("_alone", alone), "edits")
    settled.append(edits.where("_alone").select("seq", F.lit(True).alias("accepted")))
    left = edits.where("not _alone").select("seq", "new", "id_usuario", *FIELDS)
    nobody = F.lit(None).cast("bigint").alias("id_usuario")
    return settled, left.unionByName(claims.select("seq", F.lit(True).alias("new"), nobody, *FIELDS))


def _decided(open_rows: DataFrame, users: DataFrame, last: int) -> DataFrame:
    """``seq, accepted`` of all requests that depend on others."""
    if open_rows.count() <= BLOCK or not open_rows.where(F.col("id_usuario") > last).isEmpty():
        return _replayed(open_rows, users, last)
    settled, left = _foreseen(open_rows, users, BLOCK // 10)
    return reduce(DataFrame.unionByName, [*settled, _replayed(staged(left, "requests"), users, last)])


def _replayed(open_rows: DataFrame, users: DataFrame, last: int) -> DataFrame:
    """``seq, accepted`` of requests, each decided after those before it."""
    spark = open_rows.sparkSession
    if open_rows.count() <= BLOCK:
        rows = open_rows.withColumns({"component": F.lit(0).cast("bigint"), "step": F.lit(0)})
    else:
        linked = staged(_linked(open_rows, users, last), "linked")
        placed = placed_in_component(linked, F.col("nodes")).drop("nodes")
        step = F.floor((F.col("_nth") - 1) / BLOCK).cast("int")
        rows = placed.withColumn("step", step).drop("_nth")
    rows = staged(rows, "requests")
    n_steps = (rows.agg(F.max("step")).head()[0] or 0) + 1
    schedule = staged(_schedule(rows), "schedule")
    blocks, states = new_folder(spark, "blocks"), new_folder(spark, "states")
    dealt = rows.repartition("step", "component").withColumnRenamed("step", "at")
    dealt.write.partitionBy("at").parquet(blocks)
    first = _first_state(schedule, users).repartition("at", "component")
    first.write.partitionBy("at").parquet(f"{states}/from=-1")
    late = not rows.where(F.col("id_usuario") > last).isEmpty()
    routes = schedule.where((F.col("field") == _USER) & (F.col("value").cast("bigint") > last))
    request = f"seq bigint, new boolean, id_usuario bigint, {', '.join(f'{c} string' for c in FIELDS)}, component bigint"
    n_created = 0
    for k in range(n_steps):
        block = _read_step(spark, f"{blocks}/at={k}", request)
        state = _read_step(spark, f"{states}/from=*/at={k}", _STATE.replace("at int, ", ""))
        # as text: Spark measures columns of lists anew with every row that it packs for Python, which took most of a step
        lists = F.to_json(F.struct("later", "own", "own_later")).alias("lists")
        state = state.select("component", "field", "value", "n", lists)
        every = block.unionByName(state, allowMissingColumns=True)
        told = every.groupBy("component").applyInArrow(_in_turn(k, last + 1 + n_created), f"{_STATE}, {_TOLD}")
        if late:  # an id that a new user got may be named in a later step
            told = told.join(routes, ["component", "field", "value"], "left")
            steps = F.filter("steps", lambda s: s > k)
            found = F.col("at") == _UNROUTED
            told = told.withColumns({
                "at": F.when(found, F.coalesce(F.get(steps, F.lit(0)), F.lit(_NOWHERE))).otherwise(F.col("at")),
                "later": F.when(found & (F.size(steps) > 0), F.slice(steps, 2, F.size(steps))).otherwise(F.col("later")),
            }).drop("steps")
        told.write.partitionBy("at").parquet(f"{states}/from={k}")
        if late and k + 1 < n_steps:
            made = spark.read.schema(_TOLD).parquet(f"{states}/from={k}/at={_OUTCOME}")
            n_created += made.where("new and accepted").count()
    return _read_step(spark, f"{states}/from=*/at={_OUTCOME}", _TOLD).select("seq", "accepted")


def _patched(users: DataFrame, patches: DataFrame) -> DataFrame:
    """Users after edits: per field the last value set."""
    last = patches.groupBy("id_usuario").agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in _EDITABLE)
    )
    return users.join(last, "id_usuario", "left").select(
        *(F.coalesce(f"_{c}", c).alias(c) if c in _EDITABLE else F.col(c) for c in users.columns)
    )


def handle_user_requests(users: DataFrame, creates: DataFrame, edits: DataFrame) -> UserOutcome:
    """Create and edit users in the order of ``seq``, which is unique over both kinds of requests."""
    if not all(_binary(users.schema[c].dataType) for c in FIELDS):
        raise ValueError("exact edits compare texts byte by byte, without a collation")
    ship_package(users.sparkSession)
    users = users.select(*_COLUMNS)
    last = users.agg(F.max("id_usuario")).head()[0] or 0
    open_rows = staged(_request_rows(creates, edits, users, last), "requests")
    decided = _decided(open_rows, users, last)
    new_users, patches, after = _after(users, creates, edits, decided, last)
    created = creates.select("seq", "email").join(decided, "seq", "left").select(
        "seq",
        *decide(
            (~text.email_ok(F.col("email")), 400, M.BAD_EMAIL),
            (~F.coalesce("accepted", F.lit(False)), 400, M.USER_CLASH),
        ),
    )
    known = only_asked(users, edits, "id_usuario").select("id_usuario", F.lit(True).alias("_known"))
    rows = lookup_join(edits, known, "id_usuario").join(decided, "seq", "left")
    bad_role = text.given(F.col("rol")) & ~F.col("rol").isin(M.ROLES_ADMIN)
    edited = rows.select("*", bad_role.alias("_bad_role"), F.coalesce(*_EDITABLE).isNull().alias("_empty"))
    if not edits.where(F.col("id_usuario") > last).isEmpty():
        # of ids that new users get only those that are there in time
        edited = lookup_join(edited, new_users.select("id_usuario", F.col("seq").alias("_since")), "id_usuario")
        in_time = F.col("_known").isNotNull() | (F.coalesce(F.col("_since") < F.col("seq"), F.lit(False)))
    else:
        in_time = F.col("_known").isNotNull()
    edited = edited.select(
        "seq",
        *decide(
            (~in_time, 404, M.NO_USER),
            (F.col("_bad_role"), 400, M.BAD_ROLE),
            (~F.coalesce("accepted", F.lit(True)), 400, M.EDIT_CLASH),
            (F.col("_empty"), 400, M.EDIT_EMPTY),
            done=M.USER_EDITED,
        ),
    )
    return UserOutcome(created, edited, new_users, patches, after)


def _after(
    users: DataFrame, creates: DataFrame, edits: DataFrame, decided: DataFrame, last: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New users, patches and the table after the requests decided so far."""
    won = decided.where("accepted").select("seq")
    created = creates.join(won, "seq", "left_semi").select(
        "seq", *FIELDS, F.lit(M.ROLE_NEW_USER).alias("rol"), F.lit(True).alias("activo"),
        F.lit(None).cast("timestamp_ntz").alias("ultimo_login"),
    )
    new_users = assign_ids(created, "seq", users, "id_usuario").select("seq", *_COLUMNS)
    bad_role = text.given(F.col("rol")) & ~F.col("rol").isin(M.ROLES_ADMIN)
    # edits that no other request can hinder, and those that were decided
    free = F.coalesce(*FIELDS).isNull() & F.col("rol").isNotNull() & ~bad_role & (F.col("id_usuario") <= last)
    patches = edits.where(free).unionByName(edits.where(~free).join(won, "seq", "left_semi"))
    patches = patches.select("seq", "id_usuario", *_EDITABLE)
    return new_users, patches, _patched(users.unionByName(new_users.select(*_COLUMNS)), patches)


def edit_users_exact(users: DataFrame, edits: DataFrame) -> DataFrame:
    """Decisions on edits, each against the users as the edits before it left them."""
    return handle_user_requests(users, _no_creates(users), edits).edited


def edit_users_exact_snapshot(users: DataFrame, edits: DataFrame) -> DataFrame:
    return handle_user_requests(users, _no_creates(users), edits).users


def _no_creates(users: DataFrame) -> DataFrame:
    return users.sparkSession.createDataFrame([], "seq bigint, nombre_usuario string, email string, nombre_completo string")
