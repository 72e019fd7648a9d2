"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers ``x = floor(64 c) + 1000000``. With A the matrix
of the rows ``x - mean``, divided by the root of their number, the covariance is
AᵀA. The bidiagonalisation builds orthonormal V and U with A V = U B and B upper
bidiagonal, one column at a time:

1. A pass over the rows takes ``w = A v`` and sums ``wᵀw``, ``Uᵀw`` and ``Aᵀw``:
   one row per dimension and per step leaves the tasks.
2. ``w - U Uᵀw``, scaled, is the new column of U, orthogonal to all earlier ones.
   If little of w is left the column is taken through a second pass.
3. ``Aᵀu``, made orthogonal to all of V twice, gives the next column of V.

U lies in the range of A, so ``U = A W`` with a small W that the driver keeps. A
task multiplies its rows with W again instead of reading a stored U: no state is
left on executors, and one that is lost costs the repetition of its tasks. The
singular value decomposition of B, which is as small as the number of steps,
gives the components and the deviations along them.

A run of steps ends when A or Aᵀ leads to nothing new, or when all components
asked for have converged; then a run from another start, orthogonal to V, looks
for what the first could not see (equal eigenvalues). There are never more steps
than dimensions.

Cases: rows with a NULL or empty vector, a NULL entry or one that is not finite
are left out. Rows whose vector has another length than most are left out too (of two
lengths as common the longer one counts). NULL and repeated ids are kept as they
are, repeated rows count as often as they come. Components whose eigenvalue is 0
within rounding (equal rows, fewer rows than dimensions) are not returned, so
equal rows alone, or an empty table, give no rows. Entries beyond 2^40 in size
are taken as that. ``deviation`` is NULL where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.vectors import as_vectors, finite, matrix, one_length, part_rows, slices, summed
from stockroom.shipping import map_in_arrow
from stockroom.staging import staged

COMPONENTS = 32
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
#: Vectors in a row of the staged table.
BLOCK = 4096
#: An eigenvalue below this part of the largest one is rounding.
RANK = 1e-13
#: Steps after which a run is looked at.
LOOK = 4

#: ``block(ids, A)`` gives what a task makes of some rows.
Task = Callable[[pa.Array, np.ndarray], Iterator[pa.RecordBatch]]


class Moments(NamedTuple):
    """Of all rows: their number, and for each dimension the sum and the bounds of x."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]

    def fits(self) -> bool:
        """Does every deviation fit a long?"""
        most = (max(self.n * h - s, s - self.n * lo) for s, lo, h in zip(self.sums, self.low, self.high, strict=True))
        return sum(m * m for m in most) < 1 << 63

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exact."""
        small = max(map(abs, [*self.low, *self.high]), default=0) * self.n < 1 << 62
        kind = np.int64 if small else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)


class Spectrum(NamedTuple):
    """Components as columns, the eigenvalue of each, and the sum of all eigenvalues."""

    components: np.ndarray
    values: np.ndarray
    trace: float


def rounded(values: np.ndarray) -> np.ndarray:
    """Whole numbers, without the shift, which changes no difference."""
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64)


def blocks_of(vectors: DataFrame, width: int) -> DataFrame:
    """``ids, x``: runs of rows; ``x`` holds their numbers as 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            x = rounded(matrix(batch.column("vector"), width))
            ids = pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])

    return map_in_arrow(vectors.select("vec_id", "vector"), pack, "ids array<bigint>, x binary")


def moments(blocks: DataFrame, width: int) -> Moments:
    """Exact sums over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("x").to_pylist():
                x = np.frombuffer(data, dtype=np.int64).reshape(-1, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(width)), pa.array(np.full(width, len(x))), *map(pa.array, (x.sum(0), x.min(0), x.max(0)))],
                    ["at", "n", "total", "low", "high"],
                )

    parts = map_in_arrow(blocks.select("x"), part, "at bigint, n bigint, total bigint, low bigint, high bigint")
    every = parts.groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    rows = sorted(every.collect())
    return Moments(
        rows[0]["n"] if rows else 0, [int(r["total"]) for r in rows], [r["low"] for r in rows], [r["high"] for r in rows]
    )


def _over_rows(blocks: DataFrame, known: Moments, task: Task, schema: str) -> DataFrame:
    """Apply ``task`` to the rows ``x - mean`` of every block."""
    width = len(known.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column("x").to_pylist()):
                exact = known.centred(np.frombuffer(data, dtype=np.int64).reshape(-1, width))
                ids = batch.column("ids")[k].values if "ids" in batch.schema.names else None
                yield from task(ids, exact)

    return map_in_arrow(blocks, run, schema)


class _Rows:
    """Products of the centred rows with small matrices, each of them one pass."""

    def __init__(self, blocks: DataFrame, known: Moments) -> None:
        self.blocks, self.known = blocks.select("x"), known
        self.root = known.n ** 1.5

    def product(self, v: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """``yᵀy, Uᵀy, Aᵀy`` for ``y = A v`` and ``U = A w``."""
        root = self.root

        def part(_, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
            a = exact.astype(np.float64) / root
            y = a @ v
            yield part_rows(np.concatenate([[y @ y], y @ (a @ w), y @ a]))

        k = w.shape[1]
        total = summed(_over_rows(self.blocks, self.known, part, "at int, value double"))
        return total[0], total[1 : k + 1], total[k + 1 :]

    def trace(self) -> float:
        root = self.root

        def part(_, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield part_rows(np.array([np.square(exact.astype(np.float64) / root).sum()]))

        return float(summed(_over_rows(self.blocks, self.known, part, "at int, value double"))[0])

    def whitened_covariance(self, found: Spectrum) -> np.ndarray:
        """The covariance of the whitened rows, measured on them."""
        n, k = self.known.n, len(found.values)
        scaled = found.components / np.sqrt(found.values)

        def part(_, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
            y = (exact.astype(np.float64) / n) @ scaled
            yield part_rows(np.concatenate([y.sum(0), (y.T @ y).ravel()]))

        total = summed(_over_rows(self.blocks, self.known, part, "at int, value double")) / n
        mean = total[:k]
        return total[k:].reshape(k, k) - np.outer(mean, mean)


def _start(basis: np.ndarray, seed: int) -> np.ndarray | None:
    """A unit vector orthogonal to the columns of ``basis``."""
    v = np.random.default_rng(seed).standard_normal(len(basis))
    return _cleared(v, basis)


def _cleared(v: np.ndarray, basis: np.ndarray) -> np.ndarray | None:
    """``v`` without its part in ``basis``, as a unit vector; None if nothing is left."""
    if basis.shape[1] >= len(basis):
        return None
    whole = np.linalg.norm(v)
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    left = np.linalg.norm(v)
    return v / left if left > 1e-12 * whole else None


def bidiagonalise(rows: _Rows, width: int, wanted: int, trace: float) -> Spectrum:
    """The ``wanted`` largest eigenvalues and their components."""
    basis = np.zeros((width, 0))  # V
    combos = np.zeros((width, 0))  # W
    images = np.zeros((width, 0))  # AᵀU
    b = np.zeros((width + 1, width + 1))
    floor = np.sqrt(RANK * trace)
    k, first, v = 0, 0, _start(basis, 0)
    while v is not None:
        g, scale = v, 1.0
        size, inner, image = rows.product(g, combos)
        for _ in range(3):
            left = size - inner @ inner
            b[:k, k] += scale * inner
            g, image = g - combos @ inner, image - images @ inner
            if left <= 0 or scale * np.sqrt(left) <= floor:
                left = 0.0
                break
            alpha = np.sqrt(left)
            g, image, scale = g / alpha, image / alpha, scale * alpha
            if left > 0.1 * size:
                break
            size, inner, image = rows.product(g, combos)
        basis = np.column_stack([basis, v])
        if left:
            b[k, k] = scale
            combos, images = np.column_stack([combos, g]), np.column_stack([images, image])
            step = image - scale * v
        else:  # A v is in the range of U already: the row of B is 0
            combos, images = np.column_stack([combos, np.zeros(width)]), np.column_stack([images, np.zeros(width)])
            step = np.zeros(width)
        k += 1
        beta = np.linalg.norm(step - basis @ (basis.T @ step))
        v = _cleared(step, basis) if beta > floor else None
        if trace - np.square(b).sum() <= RANK * trace:
            break  # nothing is left for other directions
        if v is None or (k - first >= LOOK and k % LOOK == 0 and _settled(b[:k, :k], first, beta, wanted)):
            if first and v is not None:
                break  # the second start found nothing larger
            first, v = k, _start(basis, k)
    q, deviations, p = np.linalg.svd(b[:k, :k])
    values = deviations**2
    kept = min(wanted, int((values > RANK * trace).sum()))
    components = basis @ p.T[:, :kept]
    largest = np.abs(components).argmax(axis=0) if kept else []
    components = components * np.sign(components[largest, np.arange(kept)])
    return Spectrum(components, values[:kept], trace)


def _settled(b: np.ndarray, first: int, beta: float, wanted: int) -> bool:
    """Are the wanted values of B final, seen from the run that began at step ``first``?"""
    left, values, _ = np.linalg.svd(b)
    if len(values) < wanted:
        return False
    if not first:
        return bool((beta * np.abs(left[-1, :wanted]) <= 1e-15 * values[0]).all())
    own, own_values, _ = np.linalg.svd(b[first:, first:])
    converged = beta * np.abs(own[-1, 0]) <= 1e-8 * max(own_values[0], 1e-300)
    return bool(converged and own_values[0] < values[wanted - 1] * (1 - 1e-6))


def fit(blocks: DataFrame, width: int, wanted: int = COMPONENTS) -> tuple[Moments, Spectrum, float]:
    """Moments, components, and the largest entry of the whitened covariance minus the identity."""
    known = moments(blocks, width)
    rows = _Rows(blocks, known)
    if not known.n:
        return known, Spectrum(np.zeros((width, 0)), np.zeros(0), 0.0), 0.0
    trace = rows.trace()
    found = bidiagonalise(rows, width, min(wanted, width), trace)
    kept = len(found.values)
    error = np.abs(rows.whitened_covariance(found) - np.eye(kept)).max() if kept else 0.0
    return known, found, float(error)


def report(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component."""
    usable, width = one_length(as_vectors(embeddings).where(finite(F.col("vector")) & (F.size("vector") > 0)))
    blocks = staged(blocks_of(usable, width), "whitening")
    known, found, error = fit(blocks, width, wanted)
    n, kept = known.n, len(found.values)
    scaled = found.components / np.sqrt(found.values)
    explained = found.values / found.trace if kept else found.values
    schema = pa.schema(
        [
            ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
            ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
        ]
    )
    fits = known.fits()

    def score(ids: pa.Array, exact: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        m = len(exact)
        if fits:
            deviation = pa.array(np.square(exact).sum(axis=1))
        else:
            whole = (sum(v * v for v in row) for row in exact.tolist())
            deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
        row = np.repeat(np.arange(m), kept)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(row)),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                pa.array(np.full(m * kept, n)),
                deviation.take(pa.array(row)),
                pa.array(((exact.astype(np.float64) / n) @ scaled).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * kept, error)),
            ],
            schema=schema,
        )

    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return _over_rows(blocks, known, score, kinds)
