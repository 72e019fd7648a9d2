"""First come, first served under several keys.

Requests claim a value under each of their keys. A request is accepted unless
an *accepted* earlier request of another owner claimed one of the same values.
Whether an earlier request was accepted matters: A and B share a name, B and C
an e-mail; A is accepted, B rejected, and C is accepted because B was not.

The requests are decided in rounds. A request that is the earliest undecided
one under every key it claims is accepted: nothing before it can stand in its
way. Its values then belong to its owner: undecided requests of others that
claim one of them are rejected, those of the same owner need no longer compete
for it. Every round decides at least the earliest undecided request, and
requests in random order need few rounds (polylogarithmic; Blelloch, Fineman
and Shun, SPAA 2012).

Long dependencies would need a round per link. So what the first rounds leave
is settled in turn: requests that share values, directly or through others,
form a component, and the first ``BLOCK`` requests of each component are decided
one after the other in one task, all components at once. As they are the
earliest of their component, nothing else can stand in their way. A component of
more than ``BLOCK`` requests takes one such step per ``BLOCK``. If no more than
``BLOCK`` requests are left altogether, one step decides them.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.operators.components import components
from stockroom.operators.joins import lookup_join
from stockroom.operators.ordered import running_count
from stockroom.shipping import ship_package
from stockroom.staging import staged

log = logging.getLogger(__name__)

#: Rounds before components are looked for; requests in random order are mostly decided by then.
CONTRACT_FROM = 6
#: Requests that one task decides in turn.
BLOCK = 100_000


def first_come(claims: DataFrame, keys: Sequence[str], contract_from: int = CONTRACT_FROM) -> DataFrame:
    """The ``seq`` of each accepted row of ``claims(seq, owner, *keys)``.

    ``seq`` is unique; a NULL key claims nothing.
    """
    open_rows = staged(claims.select("seq", "owner", *keys), "claims")
    accepted, left = [], None
    while True:
        if left is not None and (left <= BLOCK or len(accepted) >= contract_from):
            winners = _in_turn(open_rows, keys, left)
        else:
            winners = staged(unopposed(open_rows, keys), "unopposed")
        decided = staged(_settled(open_rows, winners, keys), "decided")
        accepted.append(decided.where("won").select("seq"))
        open_rows = decided.where("not won").drop("won")
        left = open_rows.count()
        log.info("round %d: %d requests undecided", len(accepted), left)
        if left == 0:
            return reduce(DataFrame.unionByName, accepted)


def unopposed(open_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that are the earliest under every key they claim; ``seq`` is their first column."""
    columns = open_rows.columns
    earliest = reduce(
        DataFrame.unionByName,
        (
            open_rows.where(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.min(F.struct(*columns)).alias("_row"))
            .select("_row.*")
            for key in keys
        ),
    )
    claimed = sum((F.col(k).isNotNull().cast("int") for k in keys), F.lit(0))
    first_under = earliest.groupBy(*columns).agg(F.count(F.lit(1)).alias("_first_under"))
    free = open_rows.where(claimed == 0)  # claims nothing that is still open
    return first_under.where(F.col("_first_under") == claimed).select(*columns).unionByName(free)


def _in_turn(open_rows: DataFrame, keys: Sequence[str], left: int) -> DataFrame:
    """The accepted rows among the first ``BLOCK`` of each component."""
    coded = open_rows
    for k, key in enumerate(keys):
        # equal values get one number, whatever equality means for their type
        named = open_rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("_low"))
        named = named.select(key, (F.col("_low") * len(keys) + k).alias(f"_code_{key}"))
        coded = lookup_join(coded, named, key)
    codes = F.array_compact(F.array(*(F.col(f"_code_{key}") for key in keys)))
    rows = staged(coded.select("seq", "owner", *keys, codes.alias("needs")), "coded")
    won = settle_in_turn(rows.select("seq", "owner", "needs", F.col("needs").alias("takes")), left)
    return staged(rows.join(won, "seq", "left_semi").drop("needs"), "winners")


def settle_in_turn(rows: DataFrame, left: int) -> DataFrame:
    """``seq`` of the accepted ones among the first rows of each component of ``rows(seq, owner, needs, takes)``.

    A row is accepted if nobody else took what it needs before, and then takes
    what nobody took before. ``left`` is the number of rows.
    """
    every = F.array_union("needs", "takes")
    if left <= BLOCK:
        first = rows.withColumn("component", F.lit(0).cast("bigint"))
    else:
        first = first_in_component(rows, every, BLOCK)
    ship_package(rows.sparkSession)
    return first.groupBy("component").applyInArrow(_decided_in_turn, "seq bigint").select("seq")


def first_in_component(rows: DataFrame, nodes: Column, block: int) -> DataFrame:
    """The first ``block`` rows of each component, with ``component``; rows are linked by common ``nodes``, numbers."""
    return placed_in_component(rows, nodes).where(F.col("_nth") <= block).drop("_nth")


def placed_in_component(rows: DataFrame, nodes: Column) -> DataFrame:
    """The rows with their ``component`` and ``_nth``, their place in it, from 1."""
    named = rows.withColumn("_nodes", nodes)
    links = named.where(F.size("_nodes") > 0).select(F.col("_nodes")[0].alias("a"), F.explode("_nodes").alias("b"))
    roots = components(links.distinct()).select(F.col("node").alias("_node"), F.col("root").alias("component"))
    # a row without nodes stands for itself, below all numbers of nodes
    own = F.coalesce(F.get("_nodes", F.lit(0)), -1 - F.col("seq"))
    placed = lookup_join(named.withColumn("_node", own), roots, "_node").drop("_nodes")
    placed = placed.withColumn("component", F.coalesce("component", "_node")).drop("_node")
    return running_count(placed, "component", "seq", "_nth")


def _decided_in_turn(table: pa.Table) -> pa.Table:
    table = table.sort_by("seq")
    taken, won = {}, []
    columns = (table.column(c).to_pylist() for c in ("seq", "owner", "needs", "takes"))
    for seq, owner, needs, takes in zip(*columns, strict=True):
        if all(taken.get(code, owner) == owner for code in needs):
            won.append(seq)
            for code in takes:
                taken.setdefault(code, owner)
    return pa.table({"seq": pa.array(won, pa.int64())})


def _settled(open_rows: DataFrame, winners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give the winners their values; rejected rows are left out."""
    rows, foreign = open_rows, F.lit(False)
    for key in keys:
        owned = winners.where(F.col(key).isNotNull()).select(key, F.col("owner").alias(f"_by_{key}")).distinct()
        rows = lookup_join(rows, owned, key)
        foreign |= F.coalesce(F.col(f"_by_{key}") != F.col("owner"), F.lit(False))
    free = [F.when(F.col(f"_by_{k}").isNull(), F.col(k)).alias(k) for k in keys]
    won = reduce(lambda a, b: a & b, (c.isNull() for c in free))
    return rows.where(~foreign).select("seq", "owner", *free, won.alias("won"))
