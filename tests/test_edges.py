"""Edge rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stockroom import messages as M
from stockroom.functions import text
from stockroom.operators import alerts, export, listing, lookup, register, users
from stockroom.operators.listing import InventoryFilter
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources.tables import Tables, collate_texts
from stockroom.streaming.sessions import activity_sessions, stream_activity_sessions

AT = datetime(2024, 3, 5, 7, 8, 9)


@pytest.fixture(scope="module")
def tables(spark):
    pieza = [
        (1, 1, "50%_a", "B1", "disponible", 1, "K", AT),
        (2, 1, "50xxa", "B2", "disponible", 9, None, None),
        (3, 8, "S3", "B3", "disponible", None, "K", datetime(2024, 3, 6)),
        (4, 3, None, None, "almacenado", 1, "K", AT),
        (5, None, "S5", "S3", None, 1, "", AT),
        (6, 2, "S3", "B6", "en_venta", 1, "K", AT),
    ]
    producto = [
        (1, "C1", "Uno", None, 1, 2),
        (2, "C2", "Dos", "", 7, 1),
        (3, "C2", None, "x", None, 5),
        (4, "C4", "Cuatro", "x", 1, None),
        (5, "C5", "Cinco", "x", 1, 0),
        (6, "C6", "Dos", "x", 1, 3),
    ]
    usuario = [
        (1, "ana", "", "ana@x.org", "Admin", True, None),
        (2, "ana", "Ana B", "b@x.org", "admin", None, AT),
        (3, "", None, "c@x.org", "salida", False, AT),
    ]
    return Tables(
        pieza=spark.createDataFrame(pieza, TABLES["pieza"]),
        producto=spark.createDataFrame(producto, TABLES["producto"]),
        dron=spark.createDataFrame([(1, "Dron 1"), (2, "Alfa")], TABLES["dron"]),
        usuario=spark.createDataFrame(usuario, TABLES["usuario"]),
    )


def ids(frame, column="id_pieza"):
    return [r[column] for r in frame.collect()]


def test_listing_keeps_orphans_newest_first_and_unknown_dates_last(tables):
    rows = listing.inventory_listing(tables).collect()
    assert [r.id_pieza for r in rows] == [3, 6, 5, 4, 1, 2]
    by_id = {r.id_pieza: r for r in rows}
    assert by_id[2].nombre_usuario == M.DELETED_USER and by_id[3].nombre_producto is None
    assert by_id[6].nombre_dron is None and by_id[1].nombre_dron == "Dron 1"


@pytest.mark.parametrize(
    "where, expected",
    [
        (InventoryFilter(), {1, 2, 3, 4, 5, 6}),
        (InventoryFilter(serie="%_A"), {1}),
        (InventoryFilter(serie="s"), {3, 5, 6}),
        (InventoryFilter(estado="disponible"), {1, 2, 3}),
        (InventoryFilter(producto="Dos"), {6}),
        (InventoryFilter(serie="5", estado="disponible", producto="Uno"), {1, 2}),
    ],
)
def test_filter(tables, where, expected):
    assert set(ids(listing.inventory_rows(tables, where))) == expected


def test_distinct_products_in_order_of_appearance(tables):
    assert ids(listing.distinct_products(tables), "nombre_producto") == [None, "Dos", "Uno"]


def test_counts(tables, spark):
    full, none = tables.pieza, tables.pieza.where("false")
    assert listing.row_count(full, "x").first() == ("x", 6, False)
    assert listing.row_count(none, "x").first() == ("x", 0, True)


def test_models_by_name(tables):
    assert ids(listing.list_models(tables), "nombre") == ["Alfa", "Dron 1"]


def test_alerts(tables):
    """Equal to the minimum raises none; NULL and zero minima raise none; no piece counts zero."""
    rows = {r.id_producto: r.stock_actual for r in alerts.low_stock_alerts(tables).collect()}
    assert rows == {2: 0, 3: 0, 6: 0}
    lines = ids(alerts.low_stock_message(tables), "linea")
    assert lines == ["Dos quedan: 0", "null quedan: 0", "Dos quedan: 0"]


def test_alert_message_as_text(tables, tmp_path):
    alerts.write_low_stock_message(tables, str(tmp_path / "m"))
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text_.splitlines() == ["Dos quedan: 0", "null quedan: 0", "Dos quedan: 0"]


def test_scan_order_and_orphans(tables, spark):
    """A bar code beats a serial; a piece without a product is not found; the lowest id wins."""
    codes = ["B1", "S3", "B3", "C2", "S5", "", None]
    scans = spark.createDataFrame(list(enumerate(codes)), REQUESTS["scan"])
    rows = {r.seq: r for r in lookup.scan_lookup(tables, scans).collect()}
    assert (rows[0].tipo, rows[0].id_pieza) == ("pieza", 1)
    assert (rows[1].tipo, rows[1].id_pieza) == ("pieza", 6)
    assert rows[2].tipo == "nuevo_producto" and rows[2].codigo_original == "B3"
    assert (rows[3].tipo, rows[3].id_producto) == ("producto", 2)
    assert rows[4].tipo == "nuevo_producto"
    shown = {r.seq: r for r in lookup.scan_display(lookup.scan_lookup(tables, scans)).collect()}
    assert shown[3].accion == "registrar_pieza" and shown[3].descripcion_mostrada == ""
    form = {r.seq: r.accepted for r in lookup.scan_form(scans).collect()}
    assert form == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False}


def test_product_stays_when_its_serial_is_refused(tables, spark):
    rows = [
        (1, AT, "NEW", "S3", "Nuevo", None, None, "K", 1),
        (2, AT, "NEW", "T1", None, None, None, "K", 1),
        (3, AT, "NEW", "T1", None, None, None, "K", 1),
        (0, AT, "NEW", "T0", "", None, None, "K", 1),
    ]
    batch = spark.createDataFrame(rows, REQUESTS["register"])
    decided = {r.seq: r.reason for r in register.register_decisions(tables, batch).collect()}
    assert decided == {0: M.NAME_REQUIRED, 1: M.SERIAL_KNOWN, 2: None, 3: M.SERIAL_KNOWN}
    assert ids(register.register_new_products(tables, batch), "id_producto") == [7]
    piece = register.register_new_pieces(tables, batch).first()
    assert (piece.seq, piece.id_pieza, piece.id_producto) == (2, 7, 7)
    label = register.label_manifest(register.register_new_pieces(tables, batch), "http://h//").first()
    assert label.ruta_etiqueta == f"http://h/codigos/{piece.codigo_barras}.png"
    assert label.fecha_impresion == "5/3/2024"


def test_register_form(spark):
    rows = [
        (1, AT, " C ", "S", "\tN ", "", None, "K", 1),
        (2, AT, "C", " ", None, None, None, "K", 1),
        (3, AT, " ", "S", None, None, None, "K", 1),
    ]
    got = register.register_form(spark.createDataFrame(rows, REQUESTS["register"])).collect()
    assert [r.reason for r in got] == [None, M.FORM_MISSING, M.FORM_NO_SUPPLIER_CODE]
    assert (got[0].codigo_original, got[0].nombre_producto, got[0].descripcion_producto) == ("C", "N", None)


def test_empty_tables(tables, spark):
    none = tables.with_(
        pieza=tables.pieza.where("false"),
        producto=tables.producto.where("false"),
        usuario=tables.usuario.where("false"),
    )
    assert export.export_inventory(none).columns == list(M.EXPORT_HEADINGS.values())
    assert export.export_inventory(none).count() == 0
    assert {r.columna: r.ancho for r in export.column_width_profile(none).collect()} == {
        h: len(h) + 2 for h in M.EXPORT_HEADINGS.values()
    }
    batch = spark.createDataFrame([(4, AT, "C", "S", "N", None, None, "K", 1)], REQUESTS["register"])
    assert register.register_new_pieces(none, batch).first().id_pieza == 1


def test_export(tables, tmp_path):
    rows = export.export_inventory(tables).collect()
    assert [r["ID Pieza"] for r in rows] == ["3", "1", "2"]
    assert [r["Fecha de Registro"] for r in rows] == ["06/03/2024 00:00", "05/03/2024 07:08", ""]
    assert [r["Registrado por"] for r in rows] == ["", "ana", ""]
    folder = export.write_export(tables, str(tmp_path), AT)
    assert folder.endswith("inventario_20240305_070809")
    parts = sorted((tmp_path / "inventario_20240305_070809" / "datos").glob("part-*.csv"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines[0].startswith("ID Pieza,Producto,Dron")
    assert any(line.startswith("1,Uno,Dron 1,B1") for line in lines)


def test_width_is_capped(tables, spark):
    long = tables.with_(pieza=tables.pieza.withColumn("caja", F.lit("x" * 60)))
    widths = {r.columna: r.ancho for r in export.column_width_profile(long).collect()}
    assert widths["Caja"] == 40 and widths["ID Pieza"] == 10


def test_user_rows(tables):
    shown = {r.id_usuario: r for r in users.user_display(tables.usuario).collect()}
    assert (shown[1].nombre_completo, shown[1].nombre_mostrado) == ("—", "ana")
    assert shown[3].nombre_mostrado == "Sin nombre" and shown[3].activo == "No"
    assert shown[1].ultimo_login == "Nunca" and shown[2].activo == "No"
    assert ids(users.list_active_users(tables), "id_usuario") == [1]
    assert "password_hash" not in users.list_active_users(tables).columns


def test_login_takes_the_lowest_id(tables, spark):
    rows = [(1, AT, "ana", True), (2, AT, "nadie", True), (3, AT, "", True), (4, AT, "ana", False)]
    got = users.login_audit(tables, spark.createDataFrame(rows, REQUESTS["login"])).orderBy("seq").collect()
    assert [r.reason for r in got] == [None, M.BAD_LOGIN, M.INACTIVE, M.BAD_LOGIN]
    assert got[0].id_usuario == 1


def test_edit_form(tables, spark):
    rows = [
        (1, 2, "Ana B", "ana", "b@x.org", "admin"),
        (2, 2, "Ana C", " ana ", "b@x.org", "Admin"),
        (3, 1, "A", "ana", "ana@x.org", "Operario"),
        (4, 2, "", "ana", "b@x.org", "admin"),
        (5, 2, "A", "ana", "b@x", "admin"),
    ]
    got = users.edit_form(tables, spark.createDataFrame(rows, REQUESTS["edit_user"]), actor=1)
    got = {r.seq: r for r in got.collect()}
    assert [got[i].reason for i in range(1, 6)] == [
        M.FORM_UNCHANGED, None, M.FORM_OWN_ROLE, M.FORM_NAME_REQUIRED, M.FORM_BAD_EMAIL,
    ]
    assert (got[2].nombre_completo, got[2].nombre_usuario, got[2].rol) == ("Ana C", None, "Admin")


def test_collation(tables, spark):
    """Comparisons ignore case where the tables and the requests are given such a collation."""
    scans = spark.createDataFrame([(1, "b1"), (2, "c4")], REQUESTS["scan"])
    assert {r.tipo for r in lookup.scan_lookup(tables, scans).collect()} == {"nuevo_producto"}
    found = lookup.scan_lookup(tables.collated("UTF8_LCASE"), collate_texts(scans, "UTF8_LCASE"))
    assert {r.seq: r.tipo for r in found.collect()} == {1: "pieza", 2: "producto"}
    rows = [(1, AT, "c1", "t", None, None, None, "K", 1), (2, AT, "C1", "T", None, None, None, "K", 1)]
    batch = collate_texts(spark.createDataFrame(rows, REQUESTS["register"]), "UTF8_LCASE")
    decided = register.register_decisions(tables.collated("UTF8_LCASE"), batch)
    assert {r.seq: r.reason for r in decided.collect()} == {1: None, 2: M.SERIAL_KNOWN}
    rows = [(1, 1, None, "Nuevo", None, None), (2, 2, None, "nuevo", None, None), (3, 3, None, "ANA", None, None)]
    batch = collate_texts(spark.createDataFrame(rows, REQUESTS["edit_user"]), "UTF8_LCASE")
    edited = users.edit_users_decisions(tables.collated("UTF8_LCASE"), batch)
    assert {r.seq: r.accepted for r in edited.collect()} == {1: True, 2: False, 3: False}


def test_times_do_not_depend_on_the_time_zone(spark):
    """In this zone the clock skips 02:30 on that day."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = spark.sql("select timestamp_ntz'2024-03-10 02:30:05.25' as at")
        row = at.select(
            text.export_date(F.col("at")),
            text.last_login_text(F.col("at")),
            text.label_date(F.col("at")),
            text.parse_timestamp(F.lit("2024-03-10 02:30:05")).cast("string"),
        ).first()
        assert tuple(row) == ("10/03/2024 02:30", "2024-03-10 02:30:05", "10/3/2024", "2024-03-10 02:30:05")
        gap = spark.sql(
            "select 1L as user_id, 'click' as event_type, explode(array("
            "timestamp_ntz'2024-03-10 01:55:00', timestamp_ntz'2024-03-10 02:04:00', "
            "timestamp_ntz'2024-03-10 03:00:00')) as ts"
        )
        assert sorted(r.eventos for r in activity_sessions(gap).collect()) == [1, 2]
        with pytest.raises(ValueError):
            stream_activity_sessions(gap)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_text_functions(spark):
    values = ["  a b \t\n", " x ", "﻿y", "", None]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    row = frame.select(text.strip(v), text.form_trim(v), text.first_given(v, "N/A")).collect()
    assert [r[0] for r in row] == ["a b", "x", "﻿y", "", None]
    assert [r[1] for r in row] == ["a b", "x", "y", "", None]
    assert [r[2] for r in row][3:] == ["N/A", "N/A"]
    one = spark.range(1)
    assert one.select(text.parse_timestamp(F.lit("2024-01-02 03:04:05"))).first()[0] == datetime(2024, 1, 2, 3, 4, 5)
    assert one.select(text.parse_timestamp(F.lit("ayer"))).first()[0] is None
    assert one.select(text.whole_number(F.lit("12")), text.whole_number(F.lit(""))).first() == (12, None)
    mails = ["a.b+c@x-y.org", "a@x", "a b@x.org", "ñ@x.org", "a@b.c"]
    got = spark.createDataFrame([(m,) for m in mails], "v string").select(
        text.email_ok(v), text.email_ok(v, form=True)
    )
    assert [tuple(r) for r in got.collect()] == [
        (True, True), (False, False), (False, False), (False, True), (False, True),
    ]
    note = one.select(text.state_note(F.lit(None).cast("string"), F.lit("x"), F.lit(" "))).first()[0]
    assert note == "Cambio de 'None' a 'x'."


def test_email_rules_on_edge_texts(spark):
    """The server's pattern allows one line feed at the end; the form's knows every white space."""
    texts = {
        "a@b.com": (True, True), "a@b.com\n": (True, False), "a@b.com\r": (False, False),
        "a@b.com\n\n": (False, False), "a@b.com\u0085": (False, True), "a@b.com\u2028": (False, False),
        "a\u00a0b@x.yy": (False, False), "a@b.c\u2003d": (False, False), "a@b.c\ufeff": (False, False),
        "\u00e1@b.cc": (False, True), "a@b.c": (False, True), "": (False, False),
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.server, r.form) for r in frame.select(
        "t", text.email_ok(F.col("t")).alias("server"), text.email_ok(F.col("t"), form=True).alias("form")
    ).collect()}
    assert got == texts
    import duckdb

    from stockroom.plans import oracle

    for t, (server, form) in texts.items():
        sql = f"select regexp_matches(?, '{oracle._EMAIL}'), regexp_matches(?, '{oracle._FORM_EMAIL}')"
        assert duckdb.execute(sql, [t, t]).fetchone() == (server, form), repr(t)


def test_no_two_pieces_share_a_code(spark):
    """Five serials that want one code, a code that a piece has, and one that a second try would give."""
    few = lambda serial, prefix, attempt: F.concat(
        F.lit(prefix), (F.length(serial) * (attempt + 1) + attempt).cast("string")
    )
    rows = spark.createDataFrame([(k, "s" * n) for k, n in enumerate([3, 3, 3, 7, 5, 3, 3, 9])], "seq bigint, numero_serie string")
    held = spark.createDataFrame([("INV5",)], "codigo_barras string")
    got = {r.seq: r.codigo_barras for r in register.unique_codes(rows, held, "INV", few).collect()}
    assert sorted(got) == list(range(8)) and len(set(got.values())) == 8
    assert got[0] == "INV3" and got[4] != "INV5" and got[7] == "INV9" and got[3] == "INV7"
    plain = register.unique_codes(rows.where("seq = 3"), held).first().codigo_barras
    assert plain == spark.range(1).select(text.piece_code(F.lit("s" * 7))).first()[0]
