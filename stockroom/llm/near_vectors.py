"""Links between embeddings of high cosine, by dual traversal of cover trees.

1. Equal vectors are one *class* with a weight, so copies meet nobody twice.
2. The trunk: farthest-first centres of a bounded sample of classes. In this
   order any beginning is a net, so the trunk is the top of a cover tree. Every
   class goes to its nearest centre; the distance is kept, so that a cell's
   covering radius is exact whatever the sample was.
3. The classes of a cell, nearest first, are cut into *blocks* of at most
   ``BLOCK``. A block is a shell around its centre, with an exact inner and outer
   radius, and becomes one row: a cover tree with its vectors (``cover_tree``).
4. Pairs of blocks whose shells are too far apart are dropped; the trees of the
   other pairs are traversed together in tasks of at most two blocks each.
5. A task returns for each vector the weight of what it links with, and a
   spanning forest of its links, never the pairs. Sums of the first are the
   numbers of links, components of the second the result.

The result is exact: the bounds only leave out what is too far apart, and pairs
at the threshold are decided by the cosine in double precision. How much the
bounds spare depends on the data: between unstructured vectors of 64 dimensions
all distances are alike, and then every pair of blocks is compared.

Cases: a vector that is NULL, empty, all zeros, or holds NULL or entries that are
not finite links with nothing and is its own component; vectors of different lengths do
not link. Repeated rows are equal vectors: each counts the others as links.
A NULL id is a component's id only if no other is there, and counts as equal to
it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm import cover_tree
from stockroom.llm.components import components
from stockroom.llm.cover_tree import Links, Side, Tree
from stockroom.llm.vectors import as_vectors, finite, slices
from stockroom.operators.joins import lookup_join
from stockroom.operators.numbering import numbered
from stockroom.session import split_hot_keys
from stockroom.shipping import map_in_arrow, ship_package
from stockroom.staging import discard, staged

LEAST = 0.9
#: Classes in a block, so a task holds two blocks.
BLOCK = 4096
#: Classes per centre of the trunk, the most centres, and the classes sampled for one centre.
CELL, MAX_CENTRES, SAMPLED = 2048, 4096, 4


def key_of(vector: np.ndarray) -> bytes:
    """128 bits that stand for a vector; 0 and -0 are the same."""
    return hashlib.blake2b((vector + 0.0).tobytes(), digest_size=16).digest()


def _keyed(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, raw``: the vectors as bytes; NULL where a vector links with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            keys, raws = [], []
            for good, values in zip(batch.column("good").to_pylist(), batch.column("vector"), strict=True):
                row = values.values.to_numpy(zero_copy_only=False) if good else np.zeros(0)
                good = bool(row.any())
                keys.append(key_of(row) if good else None)
                raws.append((row + 0.0).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], schema=schema
            )

    rows = vectors.select("vec_id", "vector", finite(F.col("vector")).alias("good"))
    return map_in_arrow(rows, run, "vec_id bigint, key binary, raw binary")


def _units(raws: list[bytes]) -> np.ndarray:
    return cover_tree.unit(np.frombuffer(b"".join(raws)).reshape(len(raws), -1))


def farthest_first(u: np.ndarray, k: int) -> np.ndarray:
    """Places of ``k`` rows, each the farthest one from those before it."""
    chosen = [0]
    cosines = u @ u[0]
    while len(chosen) < min(k, len(u)):
        chosen.append(int(cosines.argmin()))
        cosines = np.maximum(cosines, u @ u[chosen[-1]])
    return np.array(chosen)


def _trunk(classes: DataFrame, width: int, n: int) -> np.ndarray:
    """Centres for the classes of one length, at most ``MAX_CENTRES``."""
    k = min(MAX_CENTRES, max(1, n // CELL))
    own = classes.where(F.col("width") == width).orderBy("key").limit(SAMPLED * k)  # keys are hashes
    u = _units([bytes(r["raw"]) for r in own.select("raw").collect()])
    return u[farthest_first(u, k)]


def _cells(classes: DataFrame, trunk: dict[int, np.ndarray]) -> DataFrame:
    """``key, raw, weight, width, cell, away``: every class with its nearest centre and the distance."""
    schema = pa.schema(
        [
            ("key", pa.binary()), ("raw", pa.binary()), ("weight", pa.int64()), ("width", pa.int32()),
            ("cell", pa.int32()), ("away", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                cosines = _units(own.column("raw").to_pylist()) @ trunk[int(width)].T
                cell = cosines.argmax(axis=1)
                away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines[np.arange(len(cell)), cell]))
                columns = [own.column(c) for c in ("key", "raw", "weight", "width")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(away)], schema=schema)

    kinds = "key binary, raw binary, weight bigint, width int, cell int, away double"
    return map_in_arrow(classes.select("key", "raw", "weight", "width"), run, kinds)


_BLOCK_SCHEMA = pa.schema(
    [
        ("width", pa.int32()), ("cell", pa.int32()), ("part", pa.int64()), ("inner", pa.float64()),
        ("outer", pa.float64()), ("keys", pa.list_(pa.binary())), ("raw", pa.binary()), ("weights", pa.binary()),
        ("starts", pa.list_(pa.binary())), ("radii", pa.list_(pa.binary())), ("parents", pa.list_(pa.binary())),
    ]
)
_BLOCK_KINDS = (
    "width int, cell int, part bigint, inner double, outer double, keys array<binary>, raw binary, weights binary, "
    "starts array<binary>, radii array<binary>, parents array<binary>"
)


def _planted(table: pa.Table) -> pa.Table:
    """The tree of one block."""
    table = table.combine_chunks().sort_by("key")
    raws = table.column("raw").to_pylist()
    tree = cover_tree.build(_units(raws))
    away = table.column("away").to_numpy()
    keys, weights = table.column("key").to_pylist(), table.column("weight").to_numpy()
    row = {
        **{c: table.column(c)[0].as_py() for c in ("width", "cell", "part")},
        "inner": away.min(),
        "outer": away.max(),
        "keys": [keys[k] for k in tree.order],
        "raw": b"".join(raws[k] for k in tree.order),
        "weights": weights[tree.order].astype(np.int64).tobytes(),
        "starts": [x.astype(np.int32).tobytes() for x in tree.starts],
        "radii": [x.astype(np.float64).tobytes() for x in tree.radii],
        "parents": [x.astype(np.int32).tobytes() for x in tree.parents],
    }
    return pa.Table.from_pylist([row], schema=_BLOCK_SCHEMA)


def _blocks(placed: DataFrame) -> DataFrame:
    """One row per block; the classes of a cell are dealt out by their distance."""
    order = [F.col("width"), F.col("cell"), F.col("away"), F.col("key")]
    placed = numbered(placed, order, "at")
    begins = placed.groupBy("width", "cell").agg(F.min("at").alias("begin"))
    spot = F.struct("width", "cell").alias("spot")
    dealt = lookup_join(placed.select("*", spot), begins.select(spot, "begin"), "spot")
    dealt = dealt.withColumn("part", F.floor((F.col("at") - F.col("begin")) / BLOCK))
    ship_package(placed.sparkSession)
    columns = ["width", "cell", "part", "key", "raw", "weight", "away"]
    return dealt.select(*columns).groupBy("width", "cell", "part").applyInArrow(_planted, _BLOCK_KINDS)


def _near_cells(blocks: DataFrame, trunk: dict[int, np.ndarray], tau: float) -> DataFrame:
    """``width, cell, other, apart``: cells, in both orders, that are not too far apart, and their distance.

    There are at most ``MAX_CENTRES`` cells of a length.
    """
    cells = blocks.groupBy("width", "cell").agg(F.max("outer").alias("radius"))
    radii = {width: np.full(len(centres), -np.inf) for width, centres in trunk.items()}
    for r in cells.collect():
        radii[r["width"]][r["cell"]] = r["radius"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                centres, radius = trunk[width], radii[width]
                apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres @ centres[cell])))
                apart[cell] = 0.0
                other = np.flatnonzero(apart - radius - radius[cell] <= tau + cover_tree.SLACK).astype(np.int32)
                constant = [pa.array(np.full(len(other), v, dtype=np.int32)) for v in (width, cell)]
                yield pa.RecordBatch.from_arrays(
                    [*constant, pa.array(other), pa.array(apart[other])], ["width", "cell", "other", "apart"]
                )

    return map_in_arrow(cells.select("width", "cell"), run, "width int, cell int, other int, apart double")


def _pairs(blocks: DataFrame, near: DataFrame, tau: float) -> DataFrame:
    """``p, q``: names of blocks, each pair once, whose shells are not too far apart."""
    shell = blocks.select("width", "cell", "block", "inner", "outer")
    left = shell.join(near, ["width", "cell"])
    right = shell.select("width", F.col("cell").alias("other"), *(F.col(c).alias(f"{c}_") for c in ("block", "inner", "outer")))
    # the distance of two vectors is at least that of the centres less both radii; around one centre, of the radii
    between = F.greatest(
        F.col("apart") - F.col("outer") - F.col("outer_"),
        F.col("inner") - F.col("outer_") - F.col("apart"),
        F.col("inner_") - F.col("outer") - F.col("apart"),
    )
    return (
        left.join(right, ["width", "other"])
        .where((F.col("block") <= F.col("block_")) & (between <= tau + cover_tree.SLACK))
        .select(F.col("block").alias("p"), F.col("block_").alias("q"))
    )


def _side(block: dict, offset: int) -> Side:
    n = len(block["keys"])
    starts = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in block["starts"]]
    radii = [np.frombuffer(x) for x in block["radii"]]
    parents = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in block["parents"]]
    raw = np.frombuffer(block["raw"]).reshape(n, -1)
    return Side.of(raw, np.frombuffer(block["weights"], dtype=np.int64), Tree(np.arange(n), starts, radii, parents), offset)


def _traversed(blocks: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """``key, links, root``: for vectors with links in a pair of blocks, their weight, and a vector that they are joined to."""
    held = F.struct("keys", "raw", "weights", "starts", "radii", "parents")
    of = blocks.select("block", held.alias("tree"))
    both = pairs.join(of.select(F.col("block").alias("p"), F.col("tree").alias("left")), "p")
    own = both.where("p = q").select("left", F.lit(None).cast(of.schema["tree"].dataType).alias("right"))
    across = both.where("p <> q").join(of.select(F.col("block").alias("q"), F.col("tree").alias("right")), "q")
    schema = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one, other = batch.column("left")[at].as_py(), batch.column("right")[at].as_py()
                left = _side(one, 0)
                right = _side(other, len(left.u)) if other else left
                keys = one["keys"] + (other["keys"] if other else [])
                links = Links(len(keys))
                cover_tree.traverse(left, right, least, links, other is None)
                weights = links.weights()
                rows = np.flatnonzero((weights > 0) | (links.root != np.arange(len(keys))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[k] for k in rows], pa.binary()),
                        pa.array(weights[rows]),
                        pa.array([keys[k] for k in links.root[rows]], pa.binary()),
                    ],
                    schema=schema,
                )

    return map_in_arrow(own.unionByName(across.select("left", "right")), run, "key binary, links bigint, root binary")


def link(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = embeddings.sparkSession
    split_hot_keys(spark)
    keyed = staged(_keyed(as_vectors(embeddings)), "vectors")
    classes = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.min("raw").alias("raw")
    )
    classes = staged(classes.withColumn("width", (F.octet_length("raw") / 8).cast("int")), "classes")
    tau = float(np.sqrt(2.0 - 2.0 * least))
    lengths = {r["width"]: r["count"] for r in classes.groupBy("width").count().collect()}
    trunk = {width: _trunk(classes, width, n) for width, n in lengths.items()}
    name = F.concat_ws(":", "width", "cell", "part")
    blocks = staged(_blocks(_cells(classes, trunk)).withColumn("block", name), "blocks")
    pairs = _pairs(blocks, _near_cells(blocks, trunk, tau), tau)
    found = staged(_traversed(blocks, pairs, least), "links")
    discard(blocks)
    # the links counted include a vector's own row
    counts = found.groupBy("key").agg((F.sum("links") - 1).alias("n_links"))
    roots = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.select("key", "first").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component"))
    facts = lookup_join(named.select("key", "root"), lowest, "root").join(counts, "key")
    full = lookup_join(keyed.select("vec_id", "key"), staged(facts.select("key", "component", "n_links"), "facts"), "key")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return full.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
