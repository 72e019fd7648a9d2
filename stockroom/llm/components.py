"""Connected components of an edge list, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.operators.joins import lookup_join
from stockroom.staging import staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Every round sends each node's larger, then its smaller neighbours to the
    smallest one (large star and small star); the number of edges never grows,
    and the rounds are logarithmic in the size of a component in practice. A
    node with very many edges is aggregated before it is shuffled, and its
    edges may be split among tasks. A graph that needs more than ``rounds``
    is refused, not cut short.
    """
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    downward = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = staged(downward.distinct(), "edges")
    before = None
    for _ in range(rounds):
        current = staged(_small_star(_large_star(current)), "edges")
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
        if state == before:
            roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            every = nodes.distinct().join(roots, "node", "left")
            return every.select("node", F.coalesce("root", "node").alias("root"))
        before = state
    raise RuntimeError(f"components are not found after {rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour, or to itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        lookup_join(both, least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and itself, to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = lookup_join(edges, least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
