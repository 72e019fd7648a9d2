"""Make this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    Tasks that run Python import their helpers from it, whether or not the
    machines have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="stockroom-")) / "stockroom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, source.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def map_in_arrow(rows: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with a function that may use this package."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(function, schema)
