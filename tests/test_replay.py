"""Batches against the rules applied one request at a time, on crowded random data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from replay import Store, code

from stockroom.operators import checkout, greedy, lookup, numbering, ordered, products, register, state, users
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources.tables import Tables

START = datetime(2024, 1, 1)
SEEDS = [1, 2]


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r[n] for n in schema.fieldNames()) for r in rows], schema)


def world(seed):
    """Few keys, so that everything clashes; one key holds about a third of it."""
    rnd = random.Random(seed)
    store = Store(
        pieza=[
            {
                "id_pieza": i,
                "id_producto": rnd.randint(1, 12),
                "numero_serie": f"S{rnd.randint(1, 30)}",
                "codigo_barras": code(f"B{rnd.randint(1, 30)}"),
                "estado": rnd.choice(["almacenado", "almacenado", "disponible", "en_venta", None]),
                "id_usuario": rnd.randint(1, 9),
                "caja": None,
                "fecha_registro": START,
            }
            for i in range(1, 31)
        ],
        producto=[
            {
                "id_producto": i,
                "codigo_original": f"C{rnd.randint(1, 8)}",
                "nombre": f"N{rnd.randint(1, 8)}",
                "descripcion": "",
                "id_dron": 1,
                "stock_minimo": rnd.choice([None, 0, 3]),
            }
            for i in range(1, 9)
        ],
        usuario=[
            {
                "id_usuario": i,
                "nombre_usuario": f"u{i}",
                "nombre_completo": f"U {i}",
                "email": f"u{i}@x.org",
                "rol": rnd.choice(["admin", "salida", "Admin", "Operario"]),
                "activo": rnd.random() < 0.7,
                "ultimo_login": None,
            }
            for i in range(1, 9)
        ],
    )
    return rnd, store


def crowded(rnd, most, hot=1):
    return hot if rnd.random() < 0.33 else rnd.randint(1, most)


def as_tables(spark, store):
    return Tables(
        pieza=frame(spark, store.pieza, TABLES["pieza"]),
        producto=frame(spark, store.producto, TABLES["producto"]),
        dron=spark.createDataFrame([(1, "D")], TABLES["dron"]),
        usuario=frame(spark, store.usuario, TABLES["usuario"]),
    )


def statuses(decisions):
    return {r.seq: r.status for r in decisions.select("seq", "status").collect()}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", SEEDS)
def test_scan(spark, seed):
    rnd, store = world(seed)
    codes = [f"S{rnd.randint(1, 40)}" for _ in range(60)] + [code(f"B{rnd.randint(1, 40)}") for _ in range(60)]
    codes += [f"C{rnd.randint(1, 12)}" for _ in range(60)] + ["S1"] * 60
    scans = frame(spark, [{"seq": i, "codigo": c} for i, c in enumerate(codes)], REQUESTS["scan"])
    found = lookup.scan_lookup(as_tables(spark, store), scans).collect()
    got = {r.seq: (r.tipo, r.id_pieza if r.tipo == "pieza" else r.id_producto) for r in found}
    assert got == {i: store.scan(c) for i, c in enumerate(codes)}


def registrations(rnd, n):
    return [
        {
            "seq": 3 * i + 5,
            "ts": START + timedelta(minutes=i),
            "codigo_original": f"C{crowded(rnd, 25, hot=20)}",
            "numero_serie": f"S{crowded(rnd, 150, hot=99)}",
            "nombre_producto": rnd.choice([None, "", " ", "Nombre"]),
            "descripcion_producto": None,
            "id_dron": rnd.choice([None, 1]),
            "caja": f"K{i}",
            "id_usuario": rnd.randint(1, 9),
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", SEEDS)
def test_register(spark, seed):
    rnd, store = world(seed)
    requests = registrations(rnd, 300)
    rnd.shuffle(requests)
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["register"])
    products_before, pieces_before = len(store.producto), len(store.pieza)
    expected = {r["seq"]: store.register(r) for r in sorted(requests, key=lambda r: r["seq"])}
    assert statuses(register.register_decisions(tables, batch)) == expected
    assert rows_of(
        register.register_new_products(tables, batch), "id_producto", "codigo_original", "nombre"
    ) == sorted(
        (p["id_producto"], p["codigo_original"], p["nombre"]) for p in store.producto[products_before:]
    )
    columns = TABLES["pieza"].fieldNames()
    assert rows_of(register.register_new_pieces(tables, batch), *columns) == sorted(
        tuple(p[c] for c in columns) for p in store.pieza[pieces_before:]
    )


@pytest.mark.parametrize("ranges", [7, None])
@pytest.mark.parametrize("seed", SEEDS)
def test_status(spark, seed, ranges):
    rnd, store = world(seed)
    requests = [
        {
            "seq": i,
            "ts": START + timedelta(minutes=i),
            "id_pieza": crowded(rnd, 40),
            "nuevo_estado": rnd.choice(["disponible", "en_venta", "en_garantia", "almacenado", ""]),
            "id_usuario": 1,
            "observaciones": rnd.choice(["", " x ", "\t"]),
        }
        for i in range(300)
    ]
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["status"])
    expected = {r["seq"]: store.status(r) for r in requests}
    assert statuses(state.status_decisions(tables, batch)) == expected
    got = rows_of(
        state.status_movements(tables, batch, ranges),
        "seq", "id_pieza", "estado_anterior", "estado_nuevo", "observaciones",
    )
    assert got == sorted(store.movimiento)
    assert rows_of(state.status_snapshot(tables, batch), "id_pieza", "estado") == [
        (p["id_pieza"], p["estado"]) for p in store.pieza
    ]


@pytest.mark.parametrize("seed", SEEDS)
def test_checkout(spark, seed):
    rnd, store = world(seed)
    requests = [
        {"seq": i, "ts": START, "id_pieza": crowded(rnd, 40), "id_usuario": rnd.randint(1, 10),
         "observaciones": ""}
        for i in range(300)
    ]
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["checkout"])
    expected = {r["seq"]: store.checkout(r) for r in requests}
    assert statuses(checkout.checkout_decisions(tables, batch)) == expected
    movements = checkout.checkout_movements(tables, batch)
    assert rows_of(movements, "seq", "id_pieza") == sorted(store.movimiento)
    assert rows_of(checkout.checkout_snapshot(tables, movements), "id_pieza", "estado") == [
        (p["id_pieza"], p["estado"]) for p in store.pieza
    ]


def user_requests(rnd, n, keys):
    return [
        {
            "seq": i,
            "nombre_usuario": f"u{crowded(rnd, keys)}",
            "email": rnd.choice(["bad@x", f"e{rnd.randint(1, keys)}@x.org", "e1@x.org"]),
            "nombre_completo": f"U {rnd.randint(1, keys)}",
        }
        for i in range(n)
    ]


@pytest.mark.parametrize("contract_from", [0, 1000])
@pytest.mark.parametrize("seed", SEEDS)
def test_create_users(spark, monkeypatch, seed, contract_from):
    monkeypatch.setattr(users, "first_come", lambda c, k: greedy.first_come(c, k, contract_from))
    rnd, store = world(seed)
    requests = user_requests(rnd, 200, 60)
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["create_user"])
    before = len(store.usuario)
    expected = {r["seq"]: store.create_user(r) for r in requests}
    assert statuses(users.create_users_decisions(tables, batch)) == expected
    assert rows_of(users.create_users_new(tables, batch), "id_usuario", "nombre_usuario", "email") == [
        (u["id_usuario"], u["nombre_usuario"], u["email"]) for u in store.usuario[before:]
    ]


def test_a_rejected_request_blocks_nobody(spark):
    """A and B share a name, B and C an e-mail: A in, B out, C in."""
    rows = [
        {"seq": 1, "nombre_usuario": "a", "email": "1@x.org", "nombre_completo": "A"},
        {"seq": 2, "nombre_usuario": "a", "email": "2@x.org", "nombre_completo": "B"},
        {"seq": 3, "nombre_usuario": "c", "email": "2@x.org", "nombre_completo": "C"},
    ]
    tables = as_tables(spark, Store())
    batch = frame(spark, rows, REQUESTS["create_user"])
    assert statuses(users.create_users_decisions(tables, batch)) == {1: 200, 2: 400, 3: 200}


@pytest.mark.parametrize("contract_from", [0, 1000])
def test_a_chain(spark, contract_from):
    """Each row shares a key with the next, so every second one is accepted."""
    rows = [(i, i, (i + 1) // 2, 1000 + i // 2) for i in range(12)]
    claims = spark.createDataFrame(rows, "seq bigint, owner bigint, a int, b int")
    won = greedy.first_come(claims, ["a", "b"], contract_from)
    assert sorted(r.seq for r in won.collect()) == list(range(0, 12, 2))


def test_a_very_long_chain_takes_few_rounds(spark, caplog):
    i = F.col("id")
    claims = spark.range(200_000).select(
        i.alias("seq"), i.alias("owner"), F.floor((i + 1) / 2).alias("a"), F.floor(i / 2).alias("b")
    )
    with caplog.at_level("INFO", logger=greedy.__name__):
        won = greedy.first_come(claims, ["a", "b"])
    assert won.agg(F.count("*"), F.max(F.col("seq") % 2)).first()[:] == (100_000, 0)
    assert len(caplog.records) <= greedy.CONTRACT_FROM + 2


def test_claims_of_one_owner_do_not_compete(spark):
    """Owner 1 claims x twice; owner 2 comes between and loses; 3 gets y, as 2 did not."""
    rows = [(1, 1, "x", None), (2, 2, "x", "y"), (3, 1, "x", "z"), (4, 3, None, "y"), (5, 4, "q", "z"), (6, 5, "q", None)]
    claims = spark.createDataFrame(rows, "seq bigint, owner bigint, a string, b string")
    for contract_from in (0, 1000):
        won = greedy.first_come(claims, ["a", "b"], contract_from)
        assert sorted(r.seq for r in won.collect()) == [1, 3, 4, 6]


def test_sparse_sequence_numbers_and_a_hot_key(spark):
    """Numbers far apart: ranges, not spans of numbers, bound the windows."""
    rows = spark.range(3000).select(
        (F.col("id") * (1 << 30)).alias("seq"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k")
    )
    counted = ordered.running_count(rows, "k", "seq", "nth", ranges=8)
    assert counted.where("k = 0").agg(F.count("nth"), F.countDistinct("nth"), F.max("nth")).first()[:] == (2001, 2001, 2001)
    before = ordered.previous_value(rows, "k", "seq", F.col("seq"), "before", ranges=8).where("k = 0")
    assert before.where("before is null").count() == 1
    assert before.agg(F.sum(F.col("seq") - F.col("before"))).first()[0] == 2999 * (1 << 30)
    at = numbering.numbered(rows, [F.col("seq")], "at", 8)
    assert at.where(F.col("at") * (1 << 30) != F.col("seq")).count() == 0


@pytest.mark.parametrize("form", [False, True])
@pytest.mark.parametrize("seed", SEEDS)
def test_create_products(spark, seed, form):
    rnd, store = world(seed)
    requests = [
        {
            "seq": i,
            "codigo_original": f"C{rnd.randint(1, 30)}",
            "nombre": f"N{crowded(rnd, 60, hot=50)}",
            "descripcion": rnd.choice(["", "d", "d"]),
            "id_dron": 1,
            "stock_minimo": rnd.randint(-1, 5),
        }
        for i in range(200)
    ]
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["create_product"])
    before = len(store.producto)
    expected = {}
    for r in requests:
        refused = form and (not r["descripcion"] or r["stock_minimo"] < 0)
        expected[r["seq"]] = 400 if refused else store.create_product(r)
    assert statuses(products.create_products_decisions(tables, batch, form)) == expected
    assert rows_of(products.create_products_new(tables, batch, form), "id_producto", "nombre") == [
        (p["id_producto"], p["nombre"]) for p in store.producto[before:]
    ]


@pytest.mark.parametrize("seed", SEEDS)
def test_toggle(spark, seed):
    rnd, store = world(seed)
    store.usuario[0]["activo"] = None
    requests = [{"seq": i, "id_usuario": crowded(rnd, 10)} for i in range(200)]
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["toggle_user"])
    expected = []
    for r in requests:
        status = store.toggle(r)
        user = next((u for u in store.usuario if u["id_usuario"] == r["id_usuario"]), {"activo": None})
        expected.append((r["seq"], status, user["activo"]))
    for ranges in (7, None):
        assert rows_of(users.toggle_users(tables, batch, ranges), "seq", "status", "activo") == expected
    snapshot = users.toggle_snapshot(tables, batch)
    assert {r.id_usuario: r.activo for r in snapshot.collect()} == {
        u["id_usuario"]: u["activo"] for u in store.usuario
    }


@pytest.mark.parametrize("seed", SEEDS)
def test_login(spark, seed):
    rnd, store = world(seed)
    requests = [
        {
            "seq": i,
            "ts": START + timedelta(minutes=i),
            "nombre_usuario": f"u{crowded(rnd, 10)}",
            "password_ok": rnd.random() < 0.6,
        }
        for i in range(200)
    ]
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["login"])
    expected = {r["seq"]: store.login(r) for r in requests}
    assert statuses(users.login_audit(tables, batch)) == expected
    snapshot = users.last_login_snapshot(tables, batch)
    assert {r.id_usuario: r.ultimo_login for r in snapshot.collect()} == {
        u["id_usuario"]: u["ultimo_login"] for u in store.usuario
    }


def edits(rnd, n, values):
    return [
        {
            "seq": i,
            "id_usuario": crowded(rnd, 10),
            "nombre_completo": rnd.choice([None, "", f"X {i}"]),
            "nombre_usuario": rnd.choice([None, None, "", f"{values}{rnd.randint(1, 12)}"]),
            "email": rnd.choice([None, None, "", f"{values}{rnd.randint(1, 12)}@x.org"]),
            "rol": rnd.choice([None, "", "Admin", "Operario", "jefe"]),
        }
        for i in range(n)
    ]


def test_edit_in_batches_of_one(spark):
    rnd, store = world(5)
    for r in edits(rnd, 8, "u"):
        tables = as_tables(spark, store)
        batch = frame(spark, [r], REQUESTS["edit_user"])
        got = statuses(users.edit_users_decisions(tables, batch))
        snapshot = rows_of(users.edit_users_snapshot(tables, batch), "id_usuario", "nombre_usuario", "email", "rol")
        assert got == {r["seq"]: store.edit(r)}
        assert snapshot == [
            (u["id_usuario"], u["nombre_usuario"], u["email"], u["rol"]) for u in store.usuario
        ]


def batch_rule(store, requests):
    """Against the users as they are; new values belong to the first accepted claimant."""
    holder, result = {}, {}
    for r in requests:
        trial = Store(usuario=store.usuario)
        status = trial.edit(r)
        if status == 200:
            user = next(u for u in store.usuario if u["id_usuario"] == r["id_usuario"])
            claims = [(k, r[k]) for k in ("nombre_usuario", "email") if r[k] and r[k] != user[k]]
            if all(holder.get(c, r["id_usuario"]) == r["id_usuario"] for c in claims):
                holder.update((c, r["id_usuario"]) for c in claims)
            else:
                status = 400
        result[r["seq"]] = status
    return result


@pytest.mark.parametrize("seed", SEEDS)
def test_edit_batch(spark, seed):
    rnd, store = world(seed)
    requests = edits(rnd, 150, "v")
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["edit_user"])
    assert statuses(users.edit_users_decisions(tables, batch)) == batch_rule(store, requests)


@pytest.mark.parametrize("seed", [1])
def test_edit_batch_that_gives_up_nothing_twice_equals_the_replay(spark, seed):
    """Each user is given one new name and e-mail at most, so no value is given up and wanted."""
    rnd, store = world(seed)
    requests, named = [], set()
    for r in edits(rnd, 150, "v"):
        if r["id_usuario"] in named or (not r["nombre_usuario"] and not r["email"]):
            r["nombre_usuario"] = r["email"] = None
        else:
            named.add(r["id_usuario"])
        requests.append(r)
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["edit_user"])
    expected = {r["seq"]: store.edit(r) for r in requests}
    assert statuses(users.edit_users_decisions(tables, batch)) == expected
    columns = ["id_usuario", "nombre_completo", "nombre_usuario", "email", "rol"]
    assert rows_of(users.edit_users_snapshot(tables, batch), *columns) == [
        tuple(u[c] for c in columns) for u in store.usuario
    ]
