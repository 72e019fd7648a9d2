"""Reading and writing tables and requests."""

import json
from datetime import datetime

import pytest

from stockroom.operators.state import status_snapshot
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources import requests, sinks, tables, testdata


def test_tables_round_trip(spark, small, tmp_path):
    root = str(tmp_path)
    made = testdata.tables(spark, small)
    for name in ("pieza", "producto", "dron", "usuario"):
        tables.append_rows(getattr(made, name), root, name, 0)
    loaded = tables.load_tables(spark, root)
    assert loaded.pieza.schema == TABLES["pieza"]
    assert loaded.pieza.count() == made.pieza.count()
    for _ in range(2):  # a batch that is run again replaces its rows
        tables.append_rows(made.dron, root, "dron", 1)
    assert tables.load_tables(spark, root).dron.count() == 2 * made.dron.count()


def test_versions(spark, small, tmp_path):
    root = str(tmp_path)
    made = testdata.tables(spark, small)
    assert tables.latest_version(spark, root, "pieza") is None
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, root, "pieza")
    tables.write_version(made.pieza, root, "pieza", 1)
    before = made.with_(pieza=tables.read_version(spark, root, "pieza"))
    changed = status_snapshot(before, testdata.requests(spark, small, "status"))
    for _ in range(2):  # a retry writes the same version again
        tables.write_version(changed, root, "pieza", 2)
    assert tables.latest_version(spark, root, "pieza") == 2
    one, two = (tables.read_version(spark, root, "pieza", v) for v in (1, 2))
    assert one.count() == two.count() == made.pieza.count()
    assert one.where("estado = 'en_garantia'").count() == 0
    assert two.where("estado = 'en_garantia'").count() > 0


def test_half_written_version_is_not_seen(spark, small, tmp_path):
    root = str(tmp_path)
    dron = testdata.table(spark, small, "dron")
    tables.write_version(dron, root, "dron", 1)
    dron.limit(1).write.parquet(f"{root}/dron/version=2")  # never announced
    assert tables.read_version(spark, root, "dron").count() == dron.count()


def test_jdbc_options():
    options = tables.jdbc_options(
        "jdbc:x", "usuario", user="u", password="p", partition_column="id_usuario",
        lower=1, upper=9, partitions=4,
    )
    assert "password_hash" not in options["dbtable"] and "select id_usuario" in options["dbtable"]
    assert options["numPartitions"] == "4" and options["lowerBound"] == "1"
    with pytest.raises(TypeError):
        tables.jdbc_options("jdbc:x", "pieza")


def test_requests_with_defaults(spark, tmp_path):
    rows = [
        {"seq": 1, "id_pieza": 5, "nuevo_estado": "en_venta", "id_usuario": 2, "otro": 1},
        {"seq": 2, "id_pieza": 5, "id_usuario": 2, "observaciones": "x"},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = requests.read_requests(spark, "status", str(tmp_path))
    assert got.schema.fieldNames() == REQUESTS["status"].fieldNames()
    assert {r.seq: r.observaciones for r in got.collect()} == {1: "", 2: "x"}
    assert [r.seq for r in requests.complete_requests(got, "status").collect()] == [1]
    refused = requests.incomplete_decisions(got, "status").collect()
    assert [(r.seq, r.status) for r in refused] == [(2, 422)]


def test_register_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        json.dumps({"seq": 1, "codigo_original": "C", "numero_serie": "S", "caja": "K"})
    )
    row = requests.read_requests(spark, "register", str(tmp_path)).first()
    assert row.id_usuario == 1 and row.nombre_producto is None


def test_json_rows(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, datetime(2024, 1, 2))], "a int, b string, c timestamp_ntz")
    sinks.write_json_rows(frame, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text)["a"] == 1 and json.loads(text)["b"] is None
