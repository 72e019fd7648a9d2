"""Batches of several kinds, and exact edits, against one request at a time."""

import random
from datetime import timedelta

import pytest
from replay import Store
from test_replay import START, as_tables, crowded, edits, frame, world

from stockroom.operators import greedy, mixed, ownership
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources.tables import Tables

USER_COLUMNS = ["id_usuario", "nombre_usuario", "nombre_completo", "email", "rol", "activo", "ultimo_login"]


def one(rnd, kind, seq):
    """A request of a kind; ids go beyond what is there, so that some name what the batch makes."""
    ts = START + timedelta(minutes=seq)
    name, code = f"N{rnd.randint(1, 14)}", f"C{rnd.randint(1, 14)}"
    user, piece = crowded(rnd, 14), crowded(rnd, 45, hot=33)
    fields = {
        "register": {
            "ts": ts, "codigo_original": code, "numero_serie": f"S{rnd.randint(1, 80)}",
            "nombre_producto": rnd.choice([None, "", name, name]), "descripcion_producto": None, "id_dron": 1,
            "caja": "K", "id_usuario": user,
        },
        "status": {
            "ts": ts, "id_pieza": piece, "nuevo_estado": rnd.choice(["disponible", "en_venta", "almacenado"]),
            "id_usuario": user, "observaciones": rnd.choice(["", " x "]),
        },
        "checkout": {"ts": ts, "id_pieza": piece, "id_usuario": user, "observaciones": ""},
        "create_product": {
            "codigo_original": code, "nombre": name, "descripcion": "d", "id_dron": 1, "stock_minimo": 2,
        },
        "create_user": {
            "nombre_usuario": f"u{rnd.randint(1, 20)}", "email": f"u{rnd.randint(1, 20)}@x.org",
            "nombre_completo": f"U {rnd.randint(1, 30)}",
        },
        "edit_user": edits(rnd, 1, "u")[0] | {"id_usuario": user},
        "toggle_user": {"id_usuario": user},
        "login": {"ts": ts, "nombre_usuario": f"u{crowded(rnd, 20)}", "password_ok": rnd.random() < 0.8},
    }
    return fields[kind] | {"seq": seq}


def mixture(rnd, n, kinds=mixed.KINDS):
    """``(kind, request)`` in order; seq has gaps."""
    return [(kind, one(rnd, kind, 3 * k + 1)) for k in range(n) for kind in [rnd.choice(kinds)]]


def batches(spark, requests):
    kinds = {kind for kind, _ in requests}
    return {k: frame(spark, [r for kind, r in requests if kind == k], REQUESTS[k]) for k in kinds}


HANDLERS = {"edit_user": "edit", "toggle_user": "toggle"}


def replayed(store, requests):
    return {r["seq"]: getattr(store, HANDLERS.get(kind, kind))(r) for kind, r in requests}


def told(outcome):
    return {r.seq: r.status for r in outcome.decisions.select("seq", "status").collect()}


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plain(store, name, columns):
    return sorted(tuple(r[c] for c in columns) for r in getattr(store, name))


def same_tables(tables, store):
    pieces = TABLES["pieza"].fieldNames()
    assert rows(tables.pieza, pieces) == plain(store, "pieza", pieces)
    products = ["id_producto", "codigo_original", "nombre"]
    assert rows(tables.producto, products) == plain(store, "producto", products)
    assert rows(tables.usuario, USER_COLUMNS) == plain(store, "usuario", USER_COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_a_mixed_batch_equals_the_replay(spark, seed):
    rnd, store = world(seed)
    requests = mixture(rnd, 260)
    outcome = mixed.handle_batch(as_tables(spark, store), batches(spark, requests), required_state="almacenado")
    expected = replayed(store, requests)
    assert told(outcome) == expected
    assert set(expected.values()) >= {200, 400, 401, 404}
    same_tables(outcome.tables, store)
    got = {r.seq: r for r in outcome.movements.collect()}
    accepted = {r["seq"] for kind, r in requests if kind in ("register", "status", "checkout") and expected[r["seq"]] == 200}
    assert set(got) == accepted
    for seq, piece, before, after, note in (m for m in store.movimiento if len(m) == 5):
        assert (got[seq].id_pieza, got[seq].estado_anterior, got[seq].estado_nuevo, got[seq].observaciones) == (
            piece, before, after, note,
        )


def test_any_cut_gives_the_same_answers(spark):
    rnd, store = world(7)
    requests = mixture(rnd, 120)
    first = as_tables(spark, store)
    expected = replayed(store, requests)
    for cut in (1, 50):
        tables, answers = first, {}
        for part in (requests[:cut], requests[cut:]):
            outcome = mixed.handle_batch(tables, batches(spark, part))
            answers |= told(outcome)
            tables = Tables(**{n: getattr(outcome.tables, n).checkpoint() for n in Tables.NAMES})
        assert answers == expected
        same_tables(tables, store)


def test_what_one_request_makes_the_next_one_finds(spark):
    """Registered, changed, taken out by a user made, promoted and renamed in the same batch."""
    store = Store(usuario=[{"id_usuario": 1, "nombre_usuario": "a", "nombre_completo": "A", "email": "a@x.org", "rol": "Admin", "activo": True, "ultimo_login": None}])
    ts = START
    piece = {"ts": ts, "id_pieza": 1, "id_usuario": 2, "observaciones": ""}
    register = {"ts": ts, "codigo_original": "C", "numero_serie": "S", "nombre_producto": None, "descripcion_producto": None, "id_dron": 1, "caja": "K", "id_usuario": 1}
    edit = {"nombre_completo": None, "nombre_usuario": None, "email": None, "rol": None, "id_usuario": 2}
    login = {"ts": ts, "password_ok": True}
    requests = [
        ("status", piece | {"nuevo_estado": "en_venta"}),  # 404: no piece yet
        ("register", register),  # 400: no product yet
        ("create_product", {"codigo_original": "C", "nombre": "N", "descripcion": "", "id_dron": 1, "stock_minimo": 1}),
        ("register", register),
        ("toggle_user", {"id_usuario": 2}),  # 404: no user yet
        ("create_user", {"nombre_usuario": "b", "email": "b@x.org", "nombre_completo": "B"}),
        ("checkout", piece),  # 403: an Operario
        ("edit_user", edit | {"nombre_usuario": "c"}),
        ("create_user", {"nombre_usuario": "b", "email": "d@x.org", "nombre_completo": "D"}),  # b is free again
        ("login", login | {"nombre_usuario": "b"}),
        ("login", login | {"nombre_usuario": "c"}),
        ("toggle_user", {"id_usuario": 2}),
        ("login", login | {"nombre_usuario": "c"}),  # 401: switched off
        ("register", register),  # 400: the serial is known
    ]
    requests = [(kind, r | {"seq": k}) for k, (kind, r) in enumerate(requests)]
    outcome = mixed.handle_batch(as_tables(spark, store), batches(spark, requests), "disponible", ["Operario"])
    status = {**told(outcome)}
    assert [status[k] for k in range(len(requests))] == [404, 400, 200, 200, 404, 200, 200, 200, 200, 200, 200, 200, 401, 400]
    again = mixed.handle_batch(as_tables(spark, store), batches(spark, requests), "disponible")
    assert told(again)[6] == 403


def test_products_that_wait_for_each_other(spark, monkeypatch):
    """The makers of a product block and free each other in chains, in steps of a few requests."""
    rnd = random.Random(4)
    requests = mixture(rnd, 200, ("register", "create_product"))
    answers = []
    for block in (greedy.BLOCK, 9):
        store = Store()
        monkeypatch.setattr(greedy, "BLOCK", block)
        monkeypatch.setattr(mixed, "BLOCK", block)
        outcome = mixed.handle_batch(as_tables(spark, store), batches(spark, requests))
        answers.append(told(outcome))
        assert answers[-1] == replayed(store, requests)
        same_tables(outcome.tables, store)
    assert answers[0] == answers[1]


def test_only_the_first_that_waits_for_a_key_competes(spark, monkeypatch):
    """Products asked for again and again under a few names are decided in one step, whatever their codes."""
    lefts, settle = [], greedy.settle_in_turn
    monkeypatch.setattr(mixed, "settle_in_turn", lambda rows, left: lefts.append(left) or settle(rows, left))
    monkeypatch.setattr(greedy, "BLOCK", 9)
    monkeypatch.setattr(mixed, "BLOCK", 9)
    form = {"descripcion": "", "id_dron": 1, "stock_minimo": 1}
    requests = [
        ("create_product", form | {"seq": k, "codigo_original": f"D{k}", "nombre": None if k % 20 == 7 else f"M{k % 3}"})
        for k in range(60)
    ]
    store = Store()
    outcome = mixed.handle_batch(as_tables(spark, store), batches(spark, requests))
    status = told(outcome)
    assert [k for k in range(60) if status[k] == 200] == [0, 1, 2, 7, 27, 47]
    assert lefts == [6]


def test_an_empty_batch_changes_nothing(spark):
    _, store = world(1)
    outcome = mixed.handle_batch(as_tables(spark, store), {})
    assert outcome.decisions.collect() == [] and outcome.movements.collect() == []
    same_tables(outcome.tables, store)
    with pytest.raises(ValueError, match="scan"):
        mixed.handle_batch(as_tables(spark, store), {"scan": frame(spark, [], REQUESTS["scan"])})


# --- exact edits --------------------------------------------------------------


@pytest.mark.parametrize(("seed", "block"), [(1, 100_000), (3, 60)])
def test_exact_edits_equal_the_replay(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ownership, "BLOCK", block)
    rnd, store = world(seed)
    requests = edits(rnd, 150, "u")
    tables, batch = as_tables(spark, store), frame(spark, requests, REQUESTS["edit_user"])
    expected = {r["seq"]: store.edit(r) for r in requests}
    got = ownership.edit_users_exact(tables.usuario, batch)
    assert {r.seq: r.status for r in got.collect()} == expected
    columns = ["id_usuario", "nombre_completo", "nombre_usuario", "email", "rol"]
    after = ownership.edit_users_exact_snapshot(tables.usuario, batch)
    assert rows(after, columns) == plain(store, "usuario", columns)


def test_links_of_edits_are_looked_for_once(spark, monkeypatch):
    """However many steps a component takes, the links among its requests are not followed again."""
    calls, found = [], greedy.components
    monkeypatch.setattr(greedy, "components", lambda links: calls.append(1) or found(links))
    monkeypatch.setattr(ownership, "BLOCK", 15)
    rnd, store = world(3)
    requests = edits(rnd, 100, "u")
    got = ownership.edit_users_exact(as_tables(spark, store).usuario, frame(spark, requests, REQUESTS["edit_user"]))
    assert {r.seq: r.status for r in got.collect()} == {r["seq"]: store.edit(r) for r in requests}
    assert len(calls) == 1


def test_a_name_given_up_is_free_at_once_and_only_then(spark):
    _, store = world(1)
    none = {"nombre_completo": None, "email": None, "rol": None}
    asked = [(2, "u1"), (1, "new"), (2, "u1"), (1, "u1"), (3, "u2"), (1, "u1")]
    requests = [none | {"seq": k, "id_usuario": i, "nombre_usuario": n} for k, (i, n) in enumerate(asked)]
    got = ownership.edit_users_exact(as_tables(spark, store).usuario, frame(spark, requests, REQUESTS["edit_user"]))
    assert [r.status for r in got.orderBy("seq").collect()] == [400, 200, 200, 400, 200, 400]


@pytest.mark.parametrize(("seed", "late", "block"), [(1, 0, 100_000), (2, 4, 100_000), (6, 3, 40)])
def test_new_users_and_edits_in_one_order(spark, monkeypatch, seed, late, block):
    """``late``: how far edits reach beyond the last id."""
    monkeypatch.setattr(ownership, "BLOCK", block)
    rnd, store = world(seed)
    requests = mixture(rnd, 110, ("create_user", "edit_user"))
    for kind, r in requests:
        if kind == "edit_user":
            r["id_usuario"] = rnd.randint(1, 9 + late)
    tables, parts = as_tables(spark, store), batches(spark, requests)
    outcome = ownership.handle_user_requests(tables.usuario, parts["create_user"], parts["edit_user"])
    expected = replayed(store, requests)
    both = outcome.created.unionByName(outcome.edited, allowMissingColumns=True)
    assert {r.seq: r.status for r in both.collect()} == expected
    assert rows(outcome.users, USER_COLUMNS) == plain(store, "usuario", USER_COLUMNS)


@pytest.mark.parametrize("seed", [1, 2])
def test_what_the_tables_and_the_first_claims_decide_is_not_replayed(spark, monkeypatch, seed):
    """New users that ask for a few values, and edits that ask for what others keep, take no steps of their own."""
    steps, replay = [], ownership._in_turn
    monkeypatch.setattr(ownership, "_in_turn", lambda *at: steps.append(at) or replay(*at))
    monkeypatch.setattr(ownership, "BLOCK", 20)
    rnd, store = world(seed)
    requests = []
    for k in range(160):
        shaky = rnd.random() < 0.1
        if rnd.random() < 0.6:
            name = f"u{rnd.randint(1, 9)}" if shaky else rnd.choice(["p", "q", "r", "s"])
            fields = {"nombre_usuario": name, "email": f"{rnd.choice('pqrstv')}@y.org", "nombre_completo": rnd.choice("PQRSTV")}
            requests.append(("create_user", fields | {"seq": k}))
        else:
            fields = {"nombre_completo": rnd.choice([None, f"Z{k}", "P" if shaky else None]), "email": None, "rol": None}
            name = rnd.choice([None, "u9", f"u{rnd.randint(1, 9)}" if shaky else None, f"z{rnd.randint(1, 3)}" if shaky else None])
            requests.append(("edit_user", fields | {"seq": k, "id_usuario": rnd.randint(1, 4), "nombre_usuario": name}))
    tables, parts = as_tables(spark, store), batches(spark, requests)
    outcome = ownership.handle_user_requests(tables.usuario, parts["create_user"], parts["edit_user"])
    expected = replayed(store, requests)
    both = outcome.created.unionByName(outcome.edited, allowMissingColumns=True)
    assert {r.seq: r.status for r in both.collect()} == expected
    assert rows(outcome.users, USER_COLUMNS) == plain(store, "usuario", USER_COLUMNS)
    assert len(steps) <= 4


def test_exact_edits_refuse_collations(spark):
    _, store = world(1)
    tables = as_tables(spark, store).collated("UTF8_LCASE")
    with pytest.raises(ValueError, match="collation"):
        ownership.edit_users_exact(tables.usuario, frame(spark, [], REQUESTS["edit_user"]))
