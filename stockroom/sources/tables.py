"""Reading and writing the inventory tables.

A table lives in ``<root>/<name>`` as parquet, or in a JDBC database. Updates
write a whole new version into a folder of its own, ``<root>/<name>/version=N``,
and only then announce it in the manifest, so a reader never sees half a table
and a job that is retried writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stockroom.schemas import TABLES

_MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "tabla STRING, version BIGINT"


class Tables:
    """The tables an operator reads: ``pieza``, ``producto``, ``dron``, ``usuario``.

    Each is opened when an operator first asks for it.
    """

    NAMES = ("pieza", "producto", "dron", "usuario")

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]):
        missing = set(self.NAMES) - set(sources)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    def with_(self, **changed: DataFrame) -> Tables:
        return Tables(**(self._sources | changed))

    def collated(self, collation: str) -> Tables:
        """Compare texts the way ``collation`` says, e.g. ``UTF8_LCASE`` (default: byte by byte)."""
        return Tables(**{name: collate_texts(getattr(self, name), collation) for name in self.NAMES})


def collate_texts(frame: DataFrame, collation: str) -> DataFrame:
    """Give every text column of a table or request batch a collation."""
    return frame.select(
        *(
            F.collate(F.col(f.name), collation).alias(f.name)
            if isinstance(f.dataType, StringType)
            else F.col(f.name)
            for f in frame.schema.fields
        )
    )


def read_parquet_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}").select(*TABLES[name].fieldNames())


def jdbc_options(
    url: str,
    name: str,
    *,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; only the table's own columns are asked for, never a credential column.

    A table is always read in ranges of a column: a single connection would
    bring a whole table into one task.
    """
    columns = ", ".join(TABLES[name].fieldNames())
    options = {
        "url": url,
        "dbtable": f"(select {columns} from {name}) as t",
        "fetchsize": str(fetch_size),
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if driver is not None:
        options["driver"] = driver
    return options | {
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_jdbc_table(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """The same table from a database, read in ranges of the partition column."""
    frame = spark.read.format("jdbc").options(**jdbc_options(url, name, **options)).load()
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))


def load_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(**{name: partial(read_parquet_table, spark, root, name) for name in Tables.NAMES})


def append_rows(frame: DataFrame, root: str, name: str, batch: int) -> None:
    """Append the rows of a batch to a table. Appending the same batch again replaces its rows."""
    columns = TABLES[name].fieldNames()
    frame.select(*columns).write.mode("overwrite").parquet(f"{root}/{name}/lote={batch}")


# --- versions ---------------------------------------------------------------


def latest_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The newest version announced, or None."""
    try:
        manifest = spark.read.schema(_MANIFEST_SCHEMA).parquet(f"{root}/{_MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return manifest.where(F.col("tabla") == name).agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    if version is None:
        version = latest_version(spark, root, name)
        if version is None:
            raise FileNotFoundError(f"no version of {name} in {root}")
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/version={version}")


def write_version(frame: DataFrame, root: str, name: str, version: int) -> None:
    """Write a version completely, then announce it. Writing the same version again is harmless."""
    spark = frame.sparkSession
    frame.select(*TABLES[name].fieldNames()).write.mode("overwrite").parquet(
        f"{root}/{name}/version={version}"
    )
    entry = spark.range(1).select(F.lit(name).alias("tabla"), F.lit(version).cast("bigint").alias("version"))
    entry.write.mode("append").parquet(f"{root}/{_MANIFEST}")
