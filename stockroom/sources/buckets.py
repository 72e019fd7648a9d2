"""Tables in buckets, of which an update rewrites only those that it touches.

A version of a table is a manifest: for each bucket the folder that holds its
rows. An update writes the buckets that it touches into folders of its own and
then announces a manifest that names them and, for all others, the folders of
the version before. So a reader never sees half an update, an update that is
retried writes the same folders again, and what a reader opens depends on the
number of buckets, not on the number of updates. Manifests have one row per
bucket. ``expire`` deletes what no newer version names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockroom.operators.snapshot import merge_changes
from stockroom.staging import delete_folder

_MANIFEST = "cubeta STRING, version BIGINT"

Where = Callable[[], Column]


def by_hash(key: str, buckets: int) -> Where:
    """Buckets of a key by its hash."""
    return lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


class BucketedTable:
    """A table of ``schema`` below ``root``; ``where`` gives the bucket of a row from its key columns."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, key: str, where: Where) -> None:
        self.spark, self.folder, self.schema, self.key, self.where = spark, f"{root}/{name}", schema, key, where

    def entries(self, version: int) -> dict[str, int]:
        """For each bucket of a version the version that wrote it."""
        path = f"{self.folder}/_manifest/version={version}"
        return {r["cubeta"]: r["version"] for r in self.spark.read.schema(_MANIFEST).parquet(path).collect()}

    def create(self, rows: DataFrame, version: int = 0) -> None:
        self._announce(version, dict.fromkeys(self._written(rows, version), version))

    def read(self, version: int, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with ``keys`` those of the buckets that may hold them."""
        entries = self.entries(version)
        return self._open(entries, entries if keys is None else self._buckets(keys))

    def update(
        self, version: int, patches: DataFrame | None = None, added: DataFrame | None = None, base: int | None = None
    ) -> None:
        """A version with rows added, and then with ``patches``: one row per key, NULL leaves a value as it is."""
        touched = [frame for frame in (patches, added) if frame is not None]
        self._rewrite(
            version, base, touched,
            lambda old: merge_changes(old if added is None else old.unionByName(added), patches, self.key)
            if patches is not None else old.unionByName(added),
        )

    def replace(self, version: int, keys: DataFrame, rows: DataFrame, base: int | None = None) -> None:
        """A version in which ``rows`` stand for all rows with the columns of ``keys``."""
        self._rewrite(version, base, [keys], lambda old: old.join(keys, keys.columns, "left_anti").unionByName(rows))

    def expire(self, version: int) -> None:
        """Delete the folders of earlier versions that ``version`` does not name; only it and later ones stay readable."""
        named = {f"version={v}/cubeta={b}" for b, v in self.entries(version).items()}
        for folder in self._listed(self.folder):
            old = folder.startswith("version=") and int(folder.removeprefix("version=")) < version
            for bucket in self._listed(f"{self.folder}/{folder}") if old else []:
                if bucket.startswith("cubeta=") and f"{folder}/{bucket}" not in named:
                    delete_folder(self.spark, f"{self.folder}/{folder}/{bucket}")
        for manifest in self._listed(f"{self.folder}/_manifest"):
            if int(manifest.removeprefix("version=")) < version:
                delete_folder(self.spark, f"{self.folder}/_manifest/{manifest}")

    def _rewrite(
        self, version: int, base: int | None, touched: list[DataFrame], change: Callable[[DataFrame], DataFrame]
    ) -> None:
        entries = self.entries(version - 1 if base is None else base)
        buckets = sorted({b for frame in touched for b in self._buckets(frame)})
        if buckets:
            written = self._written(change(self._open(entries, buckets)), version)
            entries |= dict.fromkeys(written, version)
        self._announce(version, entries)

    def _buckets(self, keys: DataFrame) -> list[str]:
        return [r[0] for r in keys.select(self.where()).distinct().collect()]

    def _open(self, entries: dict[str, int], buckets) -> DataFrame:
        paths = [f"{self.folder}/version={entries[b]}/cubeta={b}" for b in sorted(buckets) if b in entries]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _written(self, rows: DataFrame, version: int) -> list[str]:
        """Write rows, a folder per bucket, and name the buckets."""
        path = f"{self.folder}/version={version}"
        placed = rows.select(*self.schema.fieldNames()).withColumn("cubeta", self.where())
        placed.repartition("cubeta").write.mode("overwrite").partitionBy("cubeta").parquet(path)
        return [f.removeprefix("cubeta=") for f in self._listed(path) if f.startswith("cubeta=")]

    def _announce(self, version: int, entries: dict[str, int]) -> None:
        manifest = self.spark.createDataFrame(sorted(entries.items()), _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.folder}/_manifest/version={version}")

    def _listed(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
