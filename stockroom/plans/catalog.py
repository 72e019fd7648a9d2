"""Every query by name: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.functions import text
from stockroom.operators import (
    alerts,
    checkout,
    export,
    intake,
    joins,
    journal,
    listing,
    lookup,
    mixed,
    ownership,
    products,
    register,
    state,
    users,
)
from stockroom.operators.listing import InventoryFilter
from stockroom.schemas import REQUESTS
from stockroom.session import split_hot_keys
from stockroom.sources import testdata
from stockroom.sources.requests import parsed_requests
from stockroom.sources.tables import Tables
from stockroom.streaming.sessions import activity_sessions

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries that take some.
FILTER = InventoryFilter(serie="sn0000", estado="disponible")
FILTER_PRODUCT = InventoryFilter(producto="Customer#000000001")
BASE_URL = "http://localhost:8000/"
ACTOR = 7

_REGISTRY: dict[str, Query] = {}


def _query(fn: Callable) -> Callable:
    """Register ``fn(tables, requests)`` under its own name; ``requests(kind)`` reads a batch."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        split_hot_keys(spark)
        return fn(testdata.tables(spark, sf_dir), lambda kind: testdata.requests(spark, sf_dir, kind))

    _REGISTRY[fn.__name__] = run
    return fn


# --- listings and filters ---------------------------------------------------


@_query
def inventory_listing(t: Tables, r):
    return listing.inventory_listing(t)


@_query
def inventory_filter(t: Tables, r):
    return listing.inventory_display(listing.inventory_listing(t, FILTER), rol="admin")


@_query
def inventory_by_product(t: Tables, r):
    return listing.inventory_listing(t, FILTER_PRODUCT)


@_query
def checkout_offered(t: Tables, r):
    shown = listing.inventory_display(listing.inventory_rows(t), rol="salida")
    return shown.select("id_pieza", "estado", "salida_posible")


@_query
def inventory_count(t: Tables, r):
    counts = listing.row_count(t.pieza, "inventario")
    counts = counts.unionByName(listing.row_count(alerts.low_stock_alerts(t), "alertas"))
    return counts.unionByName(listing.row_count(t.usuario.where("activo"), "usuarios"))


@_query
def distinct_products(t: Tables, r):
    return listing.distinct_products(t)


@_query
def list_models(t: Tables, r):
    return listing.list_models(t)


@_query
def list_active_users(t: Tables, r):
    return users.list_active_users(t)


@_query
def user_display(t: Tables, r):
    return users.user_display(t.usuario)


@_query
def get_users(t: Tables, r):
    return users.get_users(t, r("toggle_user"))


# --- alerts -----------------------------------------------------------------


@_query
def low_stock_alerts(t: Tables, r):
    return alerts.low_stock_alerts(t)


@_query
def low_stock_message(t: Tables, r):
    return alerts.low_stock_message(t)


# --- lookups ----------------------------------------------------------------


@_query
def scan_lookup(t: Tables, r):
    return lookup.scan_lookup(t, r("scan"))


@_query
def scan_batch(t: Tables, r):
    """Scans resolved with the whole lookup table, as the stream does batch by batch."""
    scans = r("scan")
    return lookup.resolve(scans, joins.only_asked(lookup.lookup_table(t), scans, "codigo"))


@_query
def scan_display(t: Tables, r):
    return lookup.scan_display(lookup.scan_lookup(t, r("scan")))


@_query
def scan_form(t: Tables, r):
    return lookup.scan_form(r("scan"))


@_query
def piece_by_barcode(t: Tables, r):
    return lookup.piece_by(t, r("scan"), "codigo_barras")


@_query
def piece_by_serial(t: Tables, r):
    return lookup.piece_by(t, r("scan"), "numero_serie")


@_query
def barcode_exists(t: Tables, r):
    return lookup.exists(r("scan"), "codigo", t.pieza, "codigo_barras")


@_query
def serial_exists(t: Tables, r):
    return lookup.exists(r("register"), "numero_serie", t.pieza, "numero_serie")


@_query
def product_exists(t: Tables, r):
    return lookup.exists(r("register"), "codigo_original", t.producto, "codigo_original")


@_query
def serial_new(t: Tables, r):
    return lookup.new_serials(t, r("register"))


# --- registration -----------------------------------------------------------


@_query
def register_form(t: Tables, r):
    checked = register.register_form(r("register"))
    return checked.select("seq", "nombre_producto", "accepted", "status", "reason")


@_query
def register_validated(t: Tables, r):
    """Every fiftieth request leaves out its serial."""
    serial = F.when(F.col("seq") % 50 != 0, F.col("numero_serie"))
    return register.register_validated(t, r("register").withColumn("numero_serie", serial))


@_query
def alert_refresh(t: Tables, r):
    """The alerts after a batch of registrations, as the stream writes them."""
    batch = r("register")
    after = register.tables_after(
        t, register.register_new_products(t, batch), register.register_new_pieces(t, batch)
    )
    return alerts.low_stock_alerts(after)


@_query
def register_decisions(t: Tables, r):
    return register.register_decisions(t, r("register"))


@_query
def register_new_products(t: Tables, r):
    return register.register_new_products(t, r("register"))


@_query
def register_new_pieces(t: Tables, r):
    return register.register_new_pieces(t, r("register"))


@_query
def register_movements(t: Tables, r):
    return register.register_movements(register.register_new_pieces(t, r("register")))


@_query
def label_manifest(t: Tables, r):
    return register.label_manifest(register.register_new_pieces(t, r("register")), BASE_URL)


# --- raw requests -----------------------------------------------------------


def _ingest(kind: str) -> None:
    """Lines of JSON held against the types of their fields."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = parsed_requests(testdata.raw_requests(spark, sf_dir, kind), kind)
        return parsed.withColumn("status", F.when(F.col("errors").isNull(), 200).otherwise(422)).drop("raw")

    _REGISTRY[f"ingest_{kind}"] = run


for _kind in REQUESTS:
    _ingest(_kind)


def _raw_decisions(kind: str) -> None:
    """Answers to raw requests."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        split_hot_keys(spark)
        parsed = parsed_requests(testdata.raw_requests(spark, sf_dir, kind), kind)
        return intake.raw_decisions(testdata.tables(spark, sf_dir), parsed, kind)

    _REGISTRY[f"raw_{kind}_decisions"] = run


for _kind in ("status", "checkout", "toggle_user"):
    _raw_decisions(_kind)


# --- states, checkout, journal ----------------------------------------------


@_query
def status_decisions(t: Tables, r):
    return state.status_decisions(t, r("status"))


@_query
def status_movements(t: Tables, r):
    return state.status_movements(t, r("status"))


@_query
def status_snapshot(t: Tables, r):
    return state.status_snapshot(t, r("status"))


@_query
def status_snapshot_unvalidated(t: Tables, r):
    return state.status_snapshot(t, r("status"), validate=False)


@_query
def live_status(t: Tables, r):
    return state.live_status(r("status"))


@_query
def checkout_decisions(t: Tables, r):
    return checkout.checkout_decisions(t, r("checkout"))


@_query
def checkout_movements(t: Tables, r):
    return checkout.checkout_movements(t, r("checkout"))


@_query
def checkout_snapshot(t: Tables, r):
    return checkout.checkout_snapshot(t, checkout.checkout_movements(t, r("checkout")))


@_query
def movements_all(t: Tables, r):
    return journal.movements_all(
        register.register_movements(register.register_new_pieces(t, r("register"))),
        state.status_movements(t, r("status")),
        checkout.checkout_movements(t, r("checkout")),
    )


# --- products and users -----------------------------------------------------


@_query
def create_products_decisions(t: Tables, r):
    return products.create_products_decisions(t, r("create_product"))


@_query
def create_products_new(t: Tables, r):
    return products.create_products_new(t, r("create_product"))


@_query
def user_conflicts(t: Tables, r):
    return users.user_conflicts(t, r("create_user"))


@_query
def create_user_form(t: Tables, r):
    """Every seventh request has blanks around its texts, every eleventh an empty name."""
    name = F.when(F.col("seq") % 11 == 0, "\u2003").otherwise(F.col("nombre_completo"))
    padded = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("\u00a0 "), "email", F.lit("\t"))).otherwise(F.col("email"))
    return users.create_user_form(r("create_user").withColumns({"nombre_completo": name, "email": padded}))


@_query
def create_users_decisions(t: Tables, r):
    return users.create_users_decisions(t, r("create_user"))


@_query
def create_users_new(t: Tables, r):
    return users.create_users_new(t, r("create_user"))


@_query
def edit_form(t: Tables, r):
    return users.edit_form(t, r("edit_user"), ACTOR)


@_query
def edit_users_decisions(t: Tables, r):
    return users.edit_users_decisions(t, r("edit_user"))


@_query
def edit_users_snapshot(t: Tables, r):
    return users.edit_users_snapshot(t, r("edit_user"))


@_query
def edit_users_exact(t: Tables, r):
    return ownership.edit_users_exact(t.usuario, r("edit_user")).select("seq", "accepted", "status", "reason")


@_query
def edit_users_exact_snapshot(t: Tables, r):
    return ownership.edit_users_exact_snapshot(t.usuario, r("edit_user"))


@_query
def toggle_users(t: Tables, r):
    return users.toggle_users(t, r("toggle_user"))


@_query
def toggle_snapshot(t: Tables, r):
    return users.toggle_snapshot(t, r("toggle_user"))


@_query
def login_audit(t: Tables, r):
    return users.login_audit(t, r("login"))


@_query
def last_login(t: Tables, r):
    return users.last_login(t, r("login"))


@_query
def last_login_snapshot(t: Tables, r):
    return users.last_login_snapshot(t, r("login"))


# --- all kinds in one order -------------------------------------------------


def _mixture(t: Tables, r) -> mixed.Outcome:
    """The requests of every kind, one after the other in turn."""
    return mixed.handle_batch(
        t, {kind: r(kind).withColumn("seq", F.col("seq") * len(mixed.KINDS) + k) for k, kind in enumerate(mixed.KINDS)}
    )


@_query
def mixed_decisions(t: Tables, r):
    return _mixture(t, r).decisions.select("seq", "tipo", "accepted", "status", "reason")


@_query
def mixed_movements(t: Tables, r):
    return _mixture(t, r).movements


@_query
def mixed_snapshot(t: Tables, r):
    return _mixture(t, r).tables.pieza


@_query
def mixed_users(t: Tables, r):
    return _mixture(t, r).tables.usuario


# --- export and functions ---------------------------------------------------


@_query
def export_inventory(t: Tables, r):
    return export.export_inventory(t)


@_query
def column_width_profile(t: Tables, r):
    return export.column_width_profile(t)


@_query
def scalar_functions(t: Tables, r):
    """The scalar functions side by side over the state requests and the pieces they name."""
    note, code = F.col("observaciones"), F.col("nuevo_estado")
    return r("status").select(
        "seq",
        text.contains_ignoring_case(code, "EN_").alias("f1_contiene"),
        text.strip(note).alias("f2_recortado"),
        text.form_trim(note).alias("f2_recortado_formulario"),
        text.piece_code(F.concat(F.lit("SN"), F.col("id_pieza").cast("string"))).alias("f3_codigo"),
        F.coalesce(F.when(F.col("seq") % 2 == 0, code), F.lit("Usuario eliminado")).alias("f4_texto"),
        text.first_given(text.strip(note), "N/A").alias("f5_texto"),
        text.yes_no(F.col("id_usuario") > 60).alias("f6_si_no"),
        text.parse_timestamp(
            F.when(F.col("seq") % 3 == 0, F.lit("nada")).otherwise(
                F.substring(F.col("ts").cast("string"), 1, 19)
            )
        ).alias("f7_fecha"),
        text.export_date(F.when(F.col("seq") % 5 != 0, F.col("ts"))).alias("f8_fecha"),
        text.export_text(F.when(F.col("seq") % 7 != 0, F.col("id_usuario"))).alias("f9_texto"),
        F.col("id_pieza").cast("string").alias("f10_texto"),
        text.email_ok(F.concat(code, F.lit("@example."), F.substring(code, 1, 2))).alias("f11_correo"),
        text.email_ok(F.concat(code, note, F.lit("@x.y")), form=True).alias("f12_correo"),
        text.state_note(F.when(F.col("seq") % 2 == 0, code), code, note).alias("f13_nota"),
        text.whole_number(F.nullif(text.strip(F.substring(note, 6, 20)), F.lit(""))).alias("f15_numero"),
    )


# --- activity ---------------------------------------------------------------


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_sessions(testdata.events(spark, sf_dir))


_REGISTRY["activity_sessions"] = _activity


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _REGISTRY["low_stock_alerts"](spark, sf_dir)
