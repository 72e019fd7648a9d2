"""The plans: what is pushed, what is shuffled, what is split."""

import re

import pytest
from pyspark.sql import functions as F

from stockroom.operators import checkout, lookup, register, state, users
from stockroom.operators.joins import lookup_join
from stockroom.plans import catalog
from stockroom.session import build_session
from stockroom.sources import testdata

QUERIES = catalog.queries()


@pytest.fixture
def large(spark):
    """Plan as for tables too large to broadcast."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


_CACHE = {}


def large_plan(spark, sf_dir, name):
    """The plan of a query over large tables; building one may run jobs, so it is kept."""
    if name not in _CACHE:
        _CACHE[name] = plan(QUERIES[name](spark, sf_dir))
    return _CACHE[name]


def plan(frame, run=False):
    if run:
        frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_joins_and_no_python(large, small, name):
    text = large_plan(large, small, name)
    for bad in ("NestedLoop", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups", "MapInPandas", "MapInArrow"):
        assert bad not in text, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_global_windows_only_over_counts(large, small, name):
    """A window without a key may only run over one row per chunk."""
    lines = large_plan(large, small, name).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = "".join(lines[max(0, i - 3): i])
            if "Window" in above:
                assert "HashAggregate(keys=[_chunk" in lines[i + 1], name


@pytest.mark.parametrize("name", ["low_stock_alerts", "export_inventory", "inventory_filter"])
def test_state_filter_reaches_the_scan(spark, tmp_path, small, name):
    """On stored tables; the generated ones derive the state from another column."""
    from stockroom.operators import alerts, export, listing
    from stockroom.sources import tables as t
    from stockroom.sources import testdata

    made = testdata.tables(spark, small)
    for table in ("pieza", "producto", "dron", "usuario"):
        t.append_rows(getattr(made, table), str(tmp_path), table, 0)
    stored = t.load_tables(spark, str(tmp_path))
    frame = {
        "low_stock_alerts": lambda: alerts.low_stock_alerts(stored),
        "export_inventory": lambda: export.export_inventory(stored),
        "inventory_filter": lambda: listing.inventory_listing(
            stored, listing.InventoryFilter(estado="disponible", producto="x")
        ),
    }[name]()
    text = plan(frame)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(estado,disponible\)", text)
    if name == "low_stock_alerts":
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(stock_minimo,0\)", text)
        assert "ReadSchema: struct<id_pieza:bigint,id_producto:bigint,estado:string>" in text
    if name == "inventory_filter":
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(nombre,x\)", text)


def test_alerts_count_before_the_shuffle(large, small):
    text = plan(QUERIES["low_stock_alerts"](large, small))
    partial, shuffle = text.index("partial_count"), text.index("Exchange hashpartitioning(id_producto")
    assert shuffle < partial  # deeper in the plan means earlier


@pytest.fixture
def low_thresholds(large):
    """Let small partitions count as large, so that a split shows on little data."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {n: large.conf.get(n) for n in settings}
    for n, v in settings.items():
        large.conf.set(n, v)
    yield large
    for n, v in before.items():
        large.conf.set(n, v)


def crowd(spark, prefix):
    """Rows of which a third share a key."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit(prefix), F.lpad((F.col("id") % 5000).cast("string"), 9, "0"))
    )
    return spark.range(0, 300_000, 1, 16).select(F.col("id").alias("seq"), key.alias("k"))


def test_hot_key_is_split(low_thresholds):
    """The other side is an aggregate by the same key."""
    rows = crowd(low_thresholds, "k")
    table = rows.groupBy("k").agg(F.min("seq").alias("low"))
    joined = lookup_join(rows, table, "k").agg(F.sum("seq"), F.sum("low"), F.count("low"))
    assert "skew=true" in plan(joined, run=True)
    assert joined.first()[2] == 300_000


def test_operators_split_a_hot_key(low_thresholds, small):
    spark = low_thresholds
    tables = testdata.tables(spark, small)
    attempts = crowd(spark, "Supplier#").select(
        "seq", F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("k").alias("nombre_usuario"),
        F.lit(True).alias("password_ok"),
    )
    scans = crowd(spark, "SN").select("seq", F.col("k").alias("codigo"))
    changes = crowd(spark, "x").select(
        "seq", F.when(F.col("k") == "hot", 7).otherwise(F.col("seq") % 1500).cast("bigint").alias("id_pieza"),
        F.lit("en_venta").alias("nuevo_estado"),
    )
    registrations = crowd(spark, "C").select(
        "seq", F.lit(None).cast("timestamp_ntz").alias("ts"), F.col("k").alias("codigo_original"),
        F.concat(F.lit("T"), "seq").alias("numero_serie"), F.lit("N").alias("nombre_producto"),
    )
    checkouts = changes.select("seq", "id_pieza", (F.col("seq") % 9).alias("id_usuario"))
    for frame in (
        register.register_decisions(tables, registrations),
        checkout.checkout_decisions(tables, checkouts),
        users.login_audit(tables, attempts),
        lookup.scan_lookup(tables, scans),
        state.status_decisions(tables, changes),
    ):
        counted = frame.agg(F.count("*"), F.max(F.struct("*")))
        assert "skew=true" in plan(counted, run=True)
        assert counted.first()[0] == 300_000


def test_rows_without_a_key_are_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "seq bigint, k string")
    table = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    got = {r.seq: r.v for r in lookup_join(rows, table, "k").collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_session_defaults(spark):
    assert build_session().conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_are_bounded(large, small, name):
    """Windows run inside a chunk of the order, or over one row per chunk or time slot."""
    for line in large_plan(large, small, name).splitlines():
        if "Window [" in line or "Window(" in line:
            assert "_chunk" in line or "_slot" in line, line
