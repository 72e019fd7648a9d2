"""Activity sessions: a session ends ten minutes after the last activity of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StructField, StructType, TimestampNTZType

from stockroom.sources.buckets import BucketedTable
from stockroom.staging import discard, staged
from stockroom.streaming.live import start_batches, write_batch

# Fixed value: inactivity limit, in minutes (600,000 ms).
GAP_MINUTES = 10


def activity_sessions(events: DataFrame) -> DataFrame:
    """Sessions of a finished set of events.

    Two events in the same ten-minute slot are never further apart than the
    gap, so each slot is first reduced to its first and last event: an
    aggregation that combines before the shuffle. What is left per user is at
    most one row per slot of the time line, however active the user is.
    """
    gap = F.expr(f"interval {GAP_MINUTES} minutes")
    slot = F.window("ts", f"{GAP_MINUTES} minutes").start
    slots = events.groupBy("user_id", slot.alias("_slot")).agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count(F.lit(1)).alias("_events")
    )
    by_time = Window.partitionBy("user_id").orderBy("_slot")
    apart = F.coalesce(F.col("_from") > F.lag("_to").over(by_time) + gap, F.lit(True))
    return (
        slots.withColumn("_starts", apart.cast("int"))
        .withColumn("_session", F.sum("_starts").over(by_time))
        .groupBy("user_id", "_session")
        .agg(
            F.min("_from").alias("inicio"),
            (F.max("_to") + gap).alias("fin"),
            F.sum("_events").alias("eventos"),
        )
        .select("user_id", "inicio", "fin", "eventos")
    )


def stream_activity_sessions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; a session comes out once the watermark has passed its end.

    ``withWatermark`` wants a timestamp with a time zone; the session time zone
    must be UTC. Events later than ``late`` are dropped; ``session_batch_stream``
    drops none.
    """
    if events.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError("set spark.sql.session.timeZone to UTC")
    session = F.session_window("_at", f"{GAP_MINUTES} minutes")
    return (
        events.withColumn("_at", F.col("ts").cast("timestamp"))
        .withWatermark("_at", late)
        .groupBy("user_id", session.alias("_session"))
        .agg(F.count(F.lit(1)).alias("eventos"))
        .select(
            "user_id",
            F.col("_session.start").cast("timestamp_ntz").alias("inicio"),
            F.col("_session.end").cast("timestamp_ntz").alias("fin"),
            "eventos",
        )
    )


_KEYS = StructType([StructField("user_id", LongType()), StructField("dia", DateType())])
_PARTS = StructType(
    [
        *_KEYS.fields,
        StructField("desde", TimestampNTZType()),
        StructField("hasta", TimestampNTZType()),
        StructField("eventos", LongType()),
    ]
)
#: Buckets of users in each day.
BUCKETS = 16


def _parts_table(spark: SparkSession, root: str, buckets: int) -> BucketedTable:
    by_day = lambda: F.concat_ws("-", "dia", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    return BucketedTable(spark, root, "partes", _PARTS, "user_id", by_day)


def _joined(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans ``desde, hasta, eventos`` of the same keys, put together where the gap is no longer than the limit."""
    by_time = Window.partitionBy(*keys).orderBy("desde", "hasta")
    reach = F.max("hasta").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("desde") > reach + F.expr(f"interval {GAP_MINUTES} minutes"), F.lit(True))
    numbered = spans.withColumn("_starts", apart.cast("int")).withColumn("_session", F.sum("_starts").over(by_time))
    return numbered.groupBy(*keys, "_session").agg(
        F.min("desde").alias("desde"), F.max("hasta").alias("hasta"), F.sum("eventos").alias("eventos")
    ).drop("_session")


def _slots(events: DataFrame) -> DataFrame:
    """Events reduced to the first and last of each ten-minute slot, so a user and day have 144 rows at most."""
    slot = F.window("ts", f"{GAP_MINUTES} minutes").start
    rows = events.groupBy("user_id", slot.alias("_slot")).agg(
        F.min("ts").alias("desde"), F.max("ts").alias("hasta"), F.count(F.lit(1)).alias("eventos")
    )
    return rows.select("user_id", F.to_date("desde").alias("dia"), "desde", "hasta", "eventos")


def session_batch_stream(events: DataFrame, root: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Sessions that late events correct, however late they come.

    What is kept are the parts of sessions by user and day: whatever else is
    known of an event no later event can change. They lie in buckets of days and
    users (``sources/buckets``). A micro-batch opens and rewrites the buckets
    that its own events fall into and no others, so what it reads does not grow
    with the stream; events are never read again. ``latest_sessions`` puts parts
    that meet at midnight together.
    """
    table = _parts_table(events.sparkSession, root, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            table.create(batch.sparkSession.createDataFrame([], _PARTS))
        new = staged(_slots(batch), "slots")
        keys = new.select(*_KEYS.fieldNames()).distinct()
        known = table.read(batch_id, keys).join(keys, _KEYS.fieldNames(), "left_semi")
        parts = _joined(known.unionByName(new), *_KEYS.fieldNames())
        table.replace(batch_id + 1, keys, parts)
        discard(new)
        write_batch(batch.sparkSession.range(1).select(F.lit(batch_id + 1).alias("version")), root, "versiones", 0)

    return start_batches(events, root, "sessions", handle, **trigger)


def latest_sessions(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    """The sessions of every user as the last batch left them."""
    version = spark.read.parquet(f"{root}/versiones").agg(F.max("version")).head()[0]
    parts = _parts_table(spark, root, buckets).read(version).drop("dia")
    end = (F.col("hasta") + F.expr(f"interval {GAP_MINUTES} minutes")).alias("fin")
    return _joined(parts, "user_id").select("user_id", F.col("desde").alias("inicio"), end, "eventos")
