"""Clustering around centroids, with heaps of bounds that tell whom to look at again.

Components become whole numbers ``floor(1024 c)``. Every round assigns each
vector to its nearest centroid (ties: the smaller number) and moves every
centroid that has vectors to the floor of their mean. All distances are whole
numbers and exact.

A vector is rescanned, that is compared with all centroids, only if it may have
changed its cluster. At a scan the *gap* between its distance to the second
centroid and to its own is noted. When centroids move, a gap in cluster j shrinks
by at most the move of j plus the largest move of another centroid. These sums
are the *drift* of cluster j, one number per cluster. Every cluster keeps a heap
of ``gap + drift at the scan``: a vector's gap has expired when this is no more
than the drift now, so only the top of a heap is looked at, and what is popped
is rescanned exactly and pushed again, perhaps in another heap. Drift is rounded
up and gaps down, so that no rounding hides a change.

Vectors lie in blocks of ``BLOCK``, each with a heap per cluster. The blocks are
written once, dealt into buckets by block; the heaps of a round are a narrow
table dealt the same way, so a round joins the two without a shuffle. A block
reports how its rescans changed the sums of the clusters; the driver holds
``k`` centroids and ``k`` sums per dimension as exact integers. A table that is
no longer needed is deleted. A lost executor costs the repetition of its tasks.

Cases: vectors that are NULL, of another length, or hold NULL or entries that are
not finite are left out. Components beyond 2^27 in size are taken as that, so that
distances fit a long. With fewer vectors than centroids there is one centroid per
vector. Of repeated ids the smaller vector starts first; a NULL id starts last.
Repeated rows count as often as they come. A cluster without vectors keeps its
centroid. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.vectors import as_vectors, finite, matrix, slices
from stockroom.operators.joins import lookup_join
from stockroom.shipping import map_in_arrow
from stockroom.staging import delete_folder, discard, new_folder, staged

N_CENTROIDS, ROUNDS, WIDTH = 8, 10, 64
SCALE, LIMIT = 1024, 1 << 27
#: Starts are the vectors with the smallest hashes of this and their id.
SEED = "3:"
#: Vectors in a block, and blocks in a bucket.
BLOCK, BUCKET = 4096, 64

HEAPS = "block bigint, cluster binary, keys binary, rows binary, ends array<int>, change array<bigint>, rescanned bigint"


class Heaps(NamedTuple):
    """Of one block: the cluster of each vector, and per cluster a heap of (key, row)."""

    cluster: np.ndarray
    heaps: list[list[tuple[float, int]]]

    @staticmethod
    def unpack(row: dict) -> Heaps:
        keys, rows = np.frombuffer(row["keys"]), np.frombuffer(row["rows"], dtype=np.int32)
        starts = [0, *row["ends"]]
        heaps = [
            list(zip(keys[a:b].tolist(), rows[a:b].tolist(), strict=True)) for a, b in zip(starts, starts[1:], strict=False)
        ]
        return Heaps(np.frombuffer(row["cluster"], dtype=np.int32).copy(), heaps)

    def pack(self) -> dict:
        flat = [item for heap in self.heaps for item in heap]
        ends = np.cumsum([len(heap) for heap in self.heaps])
        return {
            "cluster": self.cluster.tobytes(),
            "keys": np.array([key for key, _ in flat], dtype=np.float64).tobytes(),
            "rows": np.array([row for _, row in flat], dtype=np.int32).tobytes(),
            "ends": ends.tolist(),
        }

    def expired(self, drift: list[float]) -> np.ndarray:
        """Take out the rows whose gap is used up."""
        out = []
        for heap, now in zip(self.heaps, drift, strict=True):
            while heap and heap[0][0] <= now:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), dtype=np.int64)

    def push(self, rows: np.ndarray, gaps: np.ndarray, drift: list[float]) -> None:
        """Put rows, whose cluster is up to date, into the heaps."""
        for row, gap in zip(rows.tolist(), gaps.tolist(), strict=True):
            own = int(self.cluster[row])
            heapq.heappush(self.heaps[own], (gap + drift[own], row))


def whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 1 << 53:  # then doubles hold every sum exactly
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return (np.square(a).sum(1)[:, None] - 2 * (a @ c.T) + np.square(c).sum(1)).astype(np.int64)
    return np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the gap to the next one, rounded down."""
    far = distances(x, centroids)
    best = far.argmin(axis=1)
    if len(centroids) == 1:
        return best, np.full(len(x), np.inf)
    near = np.sort(np.partition(far, 1, axis=1)[:, :2], axis=1).astype(np.float64)
    low, high = np.sqrt(near[:, 0]), np.sqrt(near[:, 1])
    return best, (high - low) - 1e-12 * (high + low) - 1e-9


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much gaps in each cluster may shrink when the centroids move, rounded up."""
    moved = np.sqrt(np.square(after - before).sum(axis=1).astype(np.float64))
    order = np.sort(moved)
    others = np.where(moved < order[-1], order[-1], order[-2] if len(order) > 1 else 0.0)
    return (moved + others) * (1 + 1e-12)


class Blocks:
    """The vectors, in blocks and buckets, and the heaps of each round beside them."""

    def __init__(self, vectors: DataFrame, width: int, buckets: int) -> None:
        self.spark, self.width, self.buckets = vectors.sparkSession, width, buckets
        self.written: list[tuple[str, str]] = []

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in slices(batches, BLOCK):
                x = whole(matrix(batch.column("vector"), width))
                ids = pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                block = pa.array([number], pa.int64())
                yield pa.RecordBatch.from_arrays([block, ids, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])
                number += 1

        kinds = "block bigint, ids array<bigint>, x binary"
        first = staged(map_in_arrow(vectors.select("vec_id", "vector"), pack, kinds), "blocks")
        self.points = self._write(first.repartition(buckets, "block"), "points")
        discard(first)
        self.heaps: DataFrame | None = None

    def _write(self, rows: DataFrame, label: str) -> DataFrame:
        folder = new_folder(self.spark, label)
        name = folder.rsplit("/", 1)[-1].replace("-", "_")
        rows.write.bucketBy(self.buckets, "block").option("path", folder).saveAsTable(name)
        self.written.append((name, folder))
        return self.spark.table(name)

    def _drop(self, at: int) -> None:
        name, folder = self.written.pop(at)
        self.spark.sql(f"DROP TABLE {name}")
        delete_folder(self.spark, folder)

    def rescan(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Bring every vector's cluster up to date with the centroids."""
        width, now, k, first = self.width, drift.tolist(), len(centroids), self.heaps is None

        def update(row: dict) -> dict:
            x = np.frombuffer(row["x"], dtype=np.int64).reshape(-1, width)
            if first:
                state, due = Heaps(np.full(len(x), -1, dtype=np.int32), [[] for _ in range(k)]), np.arange(len(x))
            else:
                state = Heaps.unpack(row)
                due = state.expired(now)
            best, gaps = scan(x[due], centroids) if len(due) else (due, due)
            before = state.cluster[due].copy()
            state.cluster[due] = best
            state.push(due, gaps, now)
            change = np.zeros((k, width + 1), dtype=np.int64)
            went = before != best
            entry = np.column_stack([np.ones(went.sum(), dtype=np.int64), x[due][went]])
            np.add.at(change, best[went], entry)
            known = before[went] >= 0
            np.subtract.at(change, before[went][known], entry[known])
            sums = change.ravel().tolist() if went.any() else []
            return {"block": row["block"], **state.pack(), "change": sums, "rescanned": len(due)}

        schema = pa.schema(
            [
                ("block", pa.int64()), ("cluster", pa.binary()), ("keys", pa.binary()), ("rows", pa.binary()),
                ("ends", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())), ("rescanned", pa.int64()),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    yield pa.RecordBatch.from_pylist([update(batch.slice(at, 1).to_pylist()[0])], schema=schema)

        rows = self.points.select("block", "x")
        if not first:
            rows = rows.join(self.heaps.select("block", "cluster", "keys", "rows", "ends"), "block")
        self.heaps = self._write(map_in_arrow(rows, run, HEAPS), "heaps")
        if len(self.written) > 2:
            self._drop(1)

    def changes(self, k: int) -> np.ndarray:
        """By how much the last scan changed the number and the sums of every cluster's vectors."""
        parts = self.heaps.select(F.posexplode("change").alias("at", "value"))
        total = np.zeros(k * (self.width + 1), dtype=np.int64)
        for at, value in parts.groupBy("at").agg(F.sum("value")).collect():
            total[at] = value
        return total.reshape(k, -1)

    def rescanned(self) -> int:
        """How many vectors the last scan looked at."""
        return self.heaps.agg(F.sum("rescanned")).head()[0]

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """``vec_id, cluster, distance`` of every vector."""
        width = self.width
        schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    x = np.frombuffer(batch.column("x")[at].as_py(), dtype=np.int64).reshape(-1, width)
                    cluster = np.frombuffer(batch.column("cluster")[at].as_py(), dtype=np.int32)
                    far = np.square(x - centroids[cluster]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("ids")[at].values, pa.array(cluster), pa.array(far)], schema=schema
                    )

        rows = self.points.join(self.heaps.select("block", "cluster"), "block").select("ids", "x", "cluster")
        return map_in_arrow(rows, run, "vec_id bigint, cluster int, distance bigint")

    def close(self) -> None:
        while self.written:
            self._drop(0)


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    order = F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "vector").select("vector").limit(k).collect()
    return whole(np.array([r["vector"] for r in first], dtype=np.float64))


def moved(centroids: np.ndarray, totals: list[list[int]]) -> np.ndarray:
    """Every centroid with vectors at the floor of their mean."""
    return np.array(
        [[s // n for s in sums] if n else old.tolist() for old, (n, *sums) in zip(centroids, totals, strict=True)],
        dtype=np.int64,
    )


def cluster(
    embeddings: DataFrame, k: int = N_CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, work: list[int] | None = None
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance``, staged, and the final centroids; ``work`` receives the rescans of each round."""
    vectors = as_vectors(embeddings).where(finite(F.col("vector")) & (F.size("vector") == width))
    centroids = starts(vectors, k)
    k = len(centroids)
    if not k:
        spark = embeddings.sparkSession
        return staged(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = Blocks(vectors, width, max(parallel, -(-vectors.count() // (BLOCK * BUCKET))))
    totals = np.zeros((k, width + 1), dtype=object)
    drift = np.zeros(k)
    for turn in range(rounds + 1):
        blocks.rescan(centroids, drift)
        if work is not None:
            work.append(blocks.rescanned())
        if turn < rounds:
            totals = totals + blocks.changes(k)
            after = moved(centroids, totals.tolist())
            drift = drift + drifts(centroids, after)
            centroids = after
    result = staged(blocks.assigned(centroids), "clusters")
    blocks.close()
    return result, centroids


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None  # such a sum fits no long


def report(embeddings: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector."""
    assigned, centroids = cluster(embeddings)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    own = {r["cluster"]: int(r["sum"]) for r in sums}
    whole_sum = sum(own.values())
    # one row per centroid
    facts = [
        (c, _long(own.get(c, 0)), _long(whole_sum), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
    ]
    kinds = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    table = assigned.sparkSession.createDataFrame(facts, kinds)
    return lookup_join(assigned, table, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
