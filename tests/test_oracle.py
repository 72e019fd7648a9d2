"""Every query against its SQL counterpart: names, types and values."""

import compare
import pytest

import __spark_entry__ as entry
from stockroom.plans import catalog, oracle

QUERIES, SQL = catalog.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    return compare.connect(small)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    frame = QUERIES[name](spark, small)
    assert compare.type_differences(frame, db, SQL[name]) == []
    assert compare.spark_rows(frame) == compare.duck_rows(db, SQL[name])


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["id_producto", "nombre", "stock_minimo", "stock_actual"]
    assert frame.count() == 67


# Counts of a one-by-one replay on the sf0.01 tables.
EXPECTED = {
    "scan_lookup": ("tipo", {"pieza": 7500, "producto": 3750, "nuevo_producto": 3750}),
    "register_decisions": (
        "reason",
        {
            None: 5501,
            "Número de serie ya registrado": 3746,
            "Nombre del producto requerido para nuevo producto": 753,
        },
    ),
    "status_decisions": ("status", {200: 7915, 400: 2017, 404: 68}),
    "checkout_decisions": ("status", {200: 49, 400: 9782, 404: 118, 403: 51}),
    "create_products_decisions": (
        "reason",
        {
            None: 3001,
            "Por favor, completa todos los campos.": 910,
            "El stock mínimo no puede ser negativo.": 454,
            "El producto ya está registrado": 5635,
        },
    ),
    "login_audit": ("status", {200: 4249, 401: 5751}),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_counts_of_the_replay(spark, medium, name):
    column, counts = EXPECTED[name]
    rows = QUERIES[name](spark, medium).groupBy(column).count().collect()
    assert {r[0]: r[1] for r in rows} == counts
