"""Session settings and the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that hold for local runs and clusters alike; anything the caller
#: passes to ``build_session`` wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Combine the events of a user inside each task before they are shuffled.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Reliable checkpoints are deleted once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "stockroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``DEFAULTS``; keyword names use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: What a split of a hot key relies on.
_SPLIT = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def split_hot_keys(spark: SparkSession) -> None:
    """Set what joins with hot keys rely on, in a session that was not built here."""
    for key, value in _SPLIT.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints.

    It is the one that ``spark.checkpoint.dir`` names; a session that names
    none keeps them below its warehouse. A warehouse on the driver's own disk
    is refused unless the session is local: executors would write where the
    driver does not read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, in the shared folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
