"""Streams against the batch answer."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockroom.operators import alerts, lookup, register, state
from stockroom.schemas import REQUESTS, TABLES
from stockroom.sources import testdata
from stockroom.sources.requests import stream_requests
from stockroom.streaming import live, sessions
from stockroom.streaming.sessions import activity_sessions, stream_activity_sessions


def drop_files(frame, folder, order, files=3):
    """Write a frame as several files, in order."""
    bounds = frame.agg(F.min(order), F.max(order)).first()
    step = (bounds[1] - bounds[0]) / files
    for i in range(files):
        part = frame.where(F.col(order) >= bounds[0] + step * i)
        if i < files - 1:
            part = part.where(F.col(order) < bounds[0] + step * (i + 1))
        part.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, kind, folder):
    return stream_requests(spark, kind, folder, fmt="parquet", glob="*.parquet", files_per_batch=1)


def rows(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def test_sessions(spark, small, tmp_path):
    events = testdata.events(spark, small)
    drop_files(events, str(tmp_path / "in"), "ts")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        stream_activity_sessions(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = activity_sessions(events)
    columns = ["user_id", "inicio", "fin", "eventos"]
    assert out.count() > 900
    closed_until = out.agg(F.max("fin")).first()[0]
    assert rows(out, *columns) == rows(batch.where(F.col("fin") <= closed_until), *columns)


def test_session_boundary(spark):
    start = datetime(2024, 1, 1)
    gaps = [timedelta(0), timedelta(minutes=10), timedelta(minutes=20, milliseconds=1), timedelta(minutes=25)]
    events = spark.createDataFrame(
        [(start + g, 1, "click") for g in gaps] + [(start, 2, "view")],
        "ts timestamp_ntz, user_id bigint, event_type string",
    )
    got = sorted((r.user_id, r.eventos) for r in activity_sessions(events).collect())
    assert got == [(1, 2), (1, 2), (2, 1)]


def test_live_status(spark, small, tmp_path):
    tables = testdata.tables(spark, small)
    requests = testdata.requests(spark, small, "status")
    drop_files(requests, str(tmp_path / "in"), "seq")
    query = live.live_status_stream(tables, stream(spark, "status", str(tmp_path / "in")), str(tmp_path / "out"))
    query.awaitTermination()
    assert query.exception() is None and len(query.recentProgress) >= 3
    journal = live.written(spark, str(tmp_path / "out"), "movimiento", TABLES["movimiento"])
    columns = TABLES["movimiento"].fieldNames()
    assert rows(journal, *columns) == rows(state.status_movements(tables, requests), *columns)
    full = spark.read.parquet(f"{tmp_path}/out/movimiento")
    assert rows(live.pieces_now(tables.pieza, full), "id_pieza", "estado") == rows(
        state.status_snapshot(tables, requests), "id_pieza", "estado"
    )


def test_register(spark, small, tmp_path):
    tables = testdata.tables(spark, small)
    requests = testdata.requests(spark, small, "register")
    drop_files(requests, str(tmp_path / "in"), "seq", files=2)
    source = stream(spark, "register", str(tmp_path / "in"))
    query = live.register_stream(tables, source, str(tmp_path / "out"))
    query.awaitTermination()
    assert query.exception() is None
    decided = spark.read.parquet(f"{tmp_path}/out/decisiones")
    assert rows(decided, "seq", "status", "reason") == rows(
        register.register_decisions(tables, requests), "seq", "status", "reason"
    )
    products, pieces = register.register_new_products(tables, requests), register.register_new_pieces(tables, requests)
    written = spark.read.parquet(f"{tmp_path}/out/pieza")
    columns = TABLES["pieza"].fieldNames()
    assert rows(written, *columns) == rows(pieces, *columns)
    final = spark.read.parquet(f"{tmp_path}/out/alertas").where("batch_id = 1")
    expected = alerts.low_stock_alerts(register.tables_after(tables, products, pieces))
    assert rows(final, "id_producto", "stock_actual") == rows(expected, "id_producto", "stock_actual")


def test_a_batch_that_is_retried_changes_nothing(spark, small, tmp_path):
    tables = testdata.tables(spark, small)
    requests = testdata.requests(spark, small, "status")
    root = str(tmp_path)
    for _ in range(2):
        live.write_batch(state.status_movements(tables, requests), root, "movimiento", 0)
    journal = live.earlier_rows(spark, root, "movimiento", TABLES["movimiento"], 1)
    assert journal.count() == state.status_movements(tables, requests).count()
    assert live.earlier_rows(spark, root, "movimiento", TABLES["movimiento"], 0).count() == 0


def test_an_unreadable_journal_is_an_error(spark, tmp_path):
    root = str(tmp_path)
    assert live.earlier_rows(spark, root, "movimiento", TABLES["movimiento"], 5).count() == 0
    folder = tmp_path / "movimiento" / "batch_id=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        live.earlier_rows(spark, root, "movimiento", TABLES["movimiento"], 5).collect()


def test_late_events_correct_their_sessions(spark, small, tmp_path):
    """An event of the first day comes last, and a batch is run twice."""
    events = spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts").where("user_id < 40")
    ordered = [r for r in events.collect()]
    ordered.sort(key=lambda r: (r.ts, r.user_id))
    late, root = ordered[:5], str(tmp_path / "root")
    for k, part in enumerate((ordered[5:200], ordered[200:], late)):
        spark.createDataFrame(part, events.schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        query = sessions.session_batch_stream(source, root)
        query.awaitTermination()
        assert query.exception() is None, k
    expected = sessions.activity_sessions(events)
    names = ("user_id", "inicio", "fin", "eventos")
    assert rows(sessions.latest_sessions(spark, root), *names) == rows(expected, *names)


def test_scans(spark, small, tmp_path):
    tables = testdata.tables(spark, small)
    scans = testdata.requests(spark, small, "scan")
    drop_files(scans, str(tmp_path / "in"), "seq")
    live.write_lookup_table(tables, str(tmp_path / "lookup"))
    table = spark.read.parquet(str(tmp_path / "lookup"))
    batch = lookup.scan_lookup(tables, scans)
    expected = rows(batch, *batch.columns)
    query = live.scan_batch_stream(table, stream(spark, "scan", str(tmp_path / "in")), str(tmp_path / "root"))
    query.awaitTermination()
    assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "root" / "hallazgos"))
    assert rows(found, *batch.columns) == expected


def test_requests_have_a_schema():
    assert all(s.fieldNames()[0] == "seq" for s in REQUESTS.values())
