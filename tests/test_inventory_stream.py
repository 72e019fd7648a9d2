"""Bucketed tables, raw requests, and the stream of all kinds."""

import json
import random

import pytest
from pyspark.sql import functions as F
from replay import Store as Replay
from test_mixed import mixture, replayed, same_tables
from test_replay import as_tables, frame, world

from stockroom.operators import alerts, intake, mixed
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources import requests as raw
from stockroom.sources.buckets import BucketedTable, by_hash
from stockroom.streaming import inventory, sessions


def pieces(spark, ids, estado="disponible"):
    return spark.createDataFrame([(i, 1, f"S{i}", f"B{i}", estado, 1, "K", None) for i in ids], TABLES["pieza"])


def folders(table, version):
    return {f"version={v}/cubeta={b}" for b, v in table.entries(version).items()}


def states(frame):
    return {r.id_pieza: r.estado for r in frame.collect()}


def test_an_update_writes_the_buckets_that_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "pieza", TABLES["pieza"], "id_pieza", by_hash("id_pieza", 8))
    table.create(pieces(spark, range(100)))
    first = folders(table, 0)
    assert len(first) == 8 and states(table.read(0)) == dict.fromkeys(range(100), "disponible")
    patch = spark.createDataFrame([(7, "en_venta"), (500, "en_venta")], "id_pieza bigint, estado string")
    for _ in range(2):  # a retry changes nothing
        table.update(1, patch, pieces(spark, [500]))
    after = {i: "disponible" for i in range(100)} | {7: "en_venta", 500: "en_venta"}
    assert states(table.read(1)) == after and states(table.read(0)) == dict.fromkeys(range(100), "disponible")
    assert 1 <= len(folders(table, 1) - first) <= 2
    asked = spark.createDataFrame([(7,)], "id_pieza bigint")
    part = states(table.read(1, asked))
    assert part[7] == "en_venta" and len(part) < 40
    table.update(2)
    assert folders(table, 2) == folders(table, 1)
    table.replace(3, asked, pieces(spark, [7], "en_reparacion"))
    assert states(table.read(3)) == after | {7: "en_reparacion"}
    table.expire(3)
    assert states(table.read(3)) == after | {7: "en_reparacion"}
    kept = {str(p.parent.relative_to(tmp_path / "pieza")) for p in (tmp_path / "pieza").glob("version=*/cubeta=*/part-*.parquet")}
    assert kept == folders(table, 3)


def test_an_empty_table_takes_updates(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "pieza", TABLES["pieza"], "id_pieza", by_hash("id_pieza", 4))
    table.create(pieces(spark, []))
    assert table.read(0).collect() == []
    table.update(1, added=pieces(spark, [1, 2]))
    assert states(table.read(1)) == {1: "disponible", 2: "disponible"}


# --- raw requests -------------------------------------------------------------


def parsed(spark, kind, *fields):
    lines = [f if isinstance(f, str) else json.dumps(f) for f in fields]
    rows = raw.parsed_requests(spark.createDataFrame([(x,) for x in lines], "raw string"), kind).collect()
    by_line = {r.raw: r for r in rows}
    return [by_line[x] for x in lines]


def test_a_value_of_a_wrong_type_is_no_default(spark):
    base = {"seq": 1, "codigo_original": "C", "numero_serie": "S", "caja": "K"}
    bad, absent, null, digits = parsed(
        spark, "register", base | {"id_usuario": "x7"}, base, base | {"id_usuario": None}, base | {"id_usuario": " 12 "}
    )
    assert bad.errors == "id_usuario: Input should be a valid integer" and bad.id_usuario is None
    assert (absent.errors, absent.id_usuario) == (None, 1)
    assert null.errors == bad.errors
    assert (digits.errors, digits.id_usuario) == (None, 12)


@pytest.mark.parametrize(
    ("value", "want"),
    [(5, 5), ("5", 5), ("+5 ", 5), (5.0, 5), (1e3, 1000), (True, 1), (5.5, None), ("5.5", None), ("", None), ([5], None),
     ({"a": 1}, None), (10**20, None), (1e300, None), (None, None), (-(2**63), -(2**63))],
)
def test_whole_numbers(spark, value, want):
    row = parsed(spark, "toggle_user", {"seq": 1, "id_usuario": value})[0]
    assert (row.id_usuario, row.errors is None) == (want, want is not None)


def test_texts_truth_values_and_times(spark):
    texts = parsed(spark, "scan", *({"seq": 1, "codigo": v} for v in ("x", "", 5, True, ["x"], None)))
    assert [r.codigo for r in texts] == ["x", "", None, None, None, None]
    assert [r.errors is None for r in texts] == [True, True, False, False, False, False]
    login = {"seq": 1, "nombre_usuario": "u", "ts": "2024-01-02T03:04:05"}
    truths = parsed(spark, "login", *(login | {"password_ok": v} for v in (True, "YES", 0, "off", 2, "maybe", 1.0)))
    assert [r.password_ok for r in truths] == [True, True, False, False, None, None, None]
    times = parsed(spark, "login", *(login | {"password_ok": True, "ts": v} for v in ("2024-01-02", "soon", 5, None)))
    assert [r.errors for r in times] == [None, *["ts: Input should be a valid datetime"] * 2, None]
    assert parsed(spark, "login", login | {"password_ok": True})[0].ts.hour == 3


def test_lines_that_are_no_requests(spark):
    rows = parsed(spark, "scan", "no json", "[1]", "{}", '{"seq": 2}', '{"seq": "a", "codigo": 1}', "")
    assert [r.errors for r in rows] == [
        raw.NO_JSON, raw.NO_JSON, "seq: Field required; codigo: Field required", "codigo: Field required",
        "seq: Input should be a valid integer; codigo: Input should be a valid string", raw.NO_JSON,
    ]


def test_refused_lines_go_to_quarantine(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"seq": 1, "codigo": "x"}\n{"seq": 2, "codigo": 7}\nnothing\n')
    rows = raw.read_raw_requests(spark, "scan", str(tmp_path / "in.json"))
    for _ in range(2):
        raw.write_quarantine(rows, str(tmp_path / "out"), "scan", 3)
    kept = spark.read.json(str(tmp_path / "out" / "scan")).orderBy("raw").collect()
    assert [(r.raw, r.lote) for r in kept] == [("nothing", 3), ('{"seq": 2, "codigo": 7}', 3)] or len(kept) == 2
    assert [r.seq for r in raw.sound_requests(rows, "scan").collect()] == [1]
    assert sorted((r.seq or 0, r.status) for r in raw.refused_decisions(rows).collect()) == [(0, 422), (2, 422)]


@pytest.mark.parametrize("kind", sorted(REQUESTS))
def test_every_kind_is_decided_or_refused(spark, kind):
    rnd, store = world(3)
    if kind == "scan":
        good = {"codigo": "S1"}
    else:
        good = {k: str(v) if hasattr(v, "isoformat") else v for k, v in dict(mixture(rnd, 1, (kind,))[0][1]).items()}
    lines = [json.dumps(good | {"seq": 1}), json.dumps({"seq": 2}), json.dumps(good | {"seq": "?"})]
    rows = raw.parsed_requests(spark.createDataFrame([(x,) for x in lines], "raw string"), kind)
    got = {r.seq: r.status for r in intake.raw_decisions(as_tables(spark, store), rows, kind).collect()}
    assert set(got) == {1, 2, None} and got[2] == got[None] == 422 and got[1] != 422


def test_raw_lines_are_parsed_once(spark):
    """What decides reads parsed columns."""
    lines = [('{"seq":1,"id_pieza":1,"nuevo_estado":"disponible","id_usuario":1}',), ("[no json",)]
    rows = raw.parsed_requests(spark.createDataFrame(lines, "raw string"), "status")
    _, store = world(3)
    decided = intake.raw_decisions(as_tables(spark, store), rows, "status")
    assert "parse_json" not in decided._jdf.queryExecution().optimizedPlan().toString()
    assert {r.status for r in decided.where("seq is null").collect()} == {422}


# --- the stream ---------------------------------------------------------------


def line(kind, request):
    return json.dumps({"tipo": kind} | {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in request.items() if v is not None})


def test_a_stream_of_all_kinds_equals_the_replay(spark, tmp_path):
    rnd, replay = world(9)
    tables = as_tables(spark, replay)
    store = inventory.Store(spark, str(tmp_path / "store"), buckets=4)
    store.open(tables)
    requests = mixture(rnd, 150)
    (tmp_path / "in").mkdir()
    expected = {}
    for k, part in enumerate((requests[:60], requests[60:61], requests[61:])):
        lines = [line(kind, r) for kind, r in part] + ['{"tipo": "toggle_user", "seq": 9999, "id_usuario": "x"}', "{}", "?"]
        rnd.shuffle(lines)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        source = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        query = inventory.inventory_stream(store, tables.dron, source)
        query.awaitTermination()
        assert query.exception() is None
        expected |= replayed(replay, part)
        now = store.tables(k + 1, tables.dron)
        same_tables(now, replay)
        # counts follow registrations, changes of state and checkouts
        columns = ["id_producto", "stock_actual"]
        want = sorted(map(tuple, alerts.low_stock_alerts(now).select(*columns).collect()))
        got = spark.read.parquet(f"{tmp_path}/store/alertas").where(F.col("batch_id") == k).select(*columns).collect()
        assert sorted(map(tuple, got)) == want
        counts = {r.id_producto: r.disponibles for r in store.existencias.read(k + 1).collect() if r.disponibles}
        assert counts == {r.id_producto: r.disponibles for r in alerts.available_pieces(now.pieza).collect()}
    told = spark.read.parquet(f"{tmp_path}/store/decisiones").collect()
    assert {r.seq: r.status for r in told if r.seq is not None and r.seq != 9999} == expected
    assert sum(r.status == 422 for r in told) == 9
    assert any(v == 200 for v in expected.values())
    # one request touched one batch's buckets only
    assert len(folders(store.pieza, 2) - folders(store.pieza, 1)) <= 1
    store.expire(3)
    same_tables(store.tables(3, tables.dron), replay)


def test_a_batch_handled_twice_counts_once(spark, tmp_path):
    rnd, replay = world(4)
    tables = as_tables(spark, replay)
    store = inventory.Store(spark, str(tmp_path), buckets=4)
    store.open(tables)
    requests = mixture(rnd, 40, ("register", "status", "checkout"))
    lines = spark.createDataFrame([(line(kind, r),) for kind, r in requests], "raw string")
    for _ in range(2):
        inventory.handle_lines(store, tables.dron, lines, 0)
    replayed(replay, requests)
    same_tables(store.tables(1, tables.dron), replay)
    counts = {r.id_producto: r.disponibles for r in store.existencias.read(1).collect() if r.disponibles}
    assert counts == {r.id_producto: r.disponibles for r in alerts.available_pieces(store.pieza.read(1)).collect()}


def test_sessions_read_only_the_days_of_a_batch(spark, small, tmp_path, monkeypatch):
    """A long stream, a day at a time: what a batch opens does not grow."""
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts").where("user_id < 30")
    rows = sorted(events.collect(), key=lambda r: r.ts)
    opened = []
    whole = BucketedTable._open
    monkeypatch.setattr(BucketedTable, "_open", lambda self, e, b: opened.append(len([x for x in b if x in e])) or whole(self, e, b))
    step, root = len(rows) // 6, str(tmp_path / "root")
    for k in range(6):
        part = rows[k * step : (k + 1) * step if k < 5 else None]
        spark.createDataFrame(part, events.schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        query = sessions.session_batch_stream(source, root, buckets=4)
        query.awaitTermination()
        assert query.exception() is None
    days = len({r.ts.date() for r in rows})
    assert max(opened) <= 4 * (days // 6 + 2) < 4 * days
    names = ("user_id", "inicio", "fin", "eventos")
    want = sessions.activity_sessions(events).select(*names).collect()
    assert sorted(map(tuple, sessions.latest_sessions(spark, root, buckets=4).select(*names).collect())) == sorted(map(tuple, want))


def test_kinds_and_random_lines_never_break_a_batch(spark, tmp_path):
    rnd = random.Random(1)
    tables = as_tables(spark, Replay())
    store = inventory.Store(spark, str(tmp_path), buckets=2)
    store.open(tables)
    junk = [json.dumps({"tipo": rnd.choice([*mixed.KINDS, "scan", None, 5]), "seq": rnd.choice([k, None, "a"])}) for k in range(60)]
    inventory.handle_lines(store, tables.dron, spark.createDataFrame([(x,) for x in junk], "raw string"), 0)
    told = spark.read.parquet(f"{tmp_path}/decisiones/batch_id=0").collect()
    assert len(told) == 60 and {r.status for r in told} <= {422, 400, 401, 404}
    assert frame(spark, [], REQUESTS["scan"]).count() == 0
