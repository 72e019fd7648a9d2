"""Shards of equal row counts that keep equal texts together, by balanced label propagation.

Documents with the same text are linked through their text, not pairwise: a
group is described by its *cells*, how many of its rows each shard holds. At the
start the linked rows are dealt out in turn, so shards are even and most links
are cut. Then rounds of joins move rows towards their neighbours:

1. Every group asks for the open shard that holds most of its rows (ties by a
   hash that changes from round to round); its other cells wish to move there.
2. The driver sums the wishes from shard to shard, a table of ``n_shards``
   squared, and grants as many rows as quotas allow. A quota is a shard's row
   count; what leaves a shard makes room in it, so opposite wishes are granted as
   swaps. Documents without a link take whatever room is left in the end.
3. From shard to shard the wishes with the largest gain are granted first; the
   last one may be granted in part. A granted move never cuts more links than it
   joins: it goes to a cell at least as large as the one that it leaves.
4. A shard that is full and can grant nothing is closed, so a group that is too
   large for one shard goes on to fill the next one.

The rounds end when nothing moves and no shard closes. Where hardly any document
is without a link they may end with some groups in pieces that no exchange can
join. Those groups alone are then dealt out anew, one after the other into the
room that all others leave, which cuts one group at the end of each shard at
most, and the rounds go on from there; the better of the two is kept. Cells are
few: a group has one per shard at most, whatever its size. A row finds its shard
through its position in its group, documents without a link fill the shards up,
and row counts are at most one apart.

Cases: a NULL text is an empty one; repeated rows are equal texts; NULL ids
come first; with fewer documents than shards some shards are empty; an empty
table gives no rows. ``shard`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.operators.joins import lookup_join
from stockroom.operators.numbering import numbered
from stockroom.operators.ordered import running_sum
from stockroom.session import split_hot_keys
from stockroom.staging import discard, fresh, staged

N_SHARDS = 16

#: Rows by shard that they are in and shard that they are for.
Flow = dict[tuple[int, int], int]


def text_key(text: Column) -> Column:
    """A name for a text: 96 bits of hash and the length."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat_ws(":", F.xxhash64(content), F.crc32(content.cast("binary")), F.octet_length(content))


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("bigint") for v in values)), index + 1)


def granted(wishes: Flow, load: list[int], capacity: list[int]) -> Flow:
    """How many rows may move from shard to shard, so that no shard holds more than its capacity.

    All wishes are granted at first; shards that would hold too much take less,
    until none does. What a shard refuses stays where it is, so this repeats.
    """
    flow = dict(wishes)
    shards = range(len(load))
    while True:
        coming = [sum(n for (_, j), n in flow.items() if j == s) for s in shards]
        going = [sum(n for (i, _), n in flow.items() if i == s) for s in shards]
        over = [load[s] + coming[s] - going[s] - capacity[s] for s in shards]
        full = [s for s in shards if over[s] > 0 and coming[s] > 0]
        if not full:
            return flow
        for s in full:
            left = min(over[s], coming[s])
            for i, j in sorted(flow, key=flow.__getitem__):
                if j == s and left:
                    less = min(left, flow[i, j])
                    flow[i, j] -= less
                    left -= less


def dealt_cells(groups: DataFrame, n_shards: int) -> DataFrame:
    """``text_key, shard, n`` with the rows of ``groups(text_key, start, n)`` dealt out in turn."""
    summed = running_sum(groups.withColumn("_all", F.lit(0)), "_all", "start", F.col("n"), "offset")
    before = lambda p: F.floor((p - F.col("shard") + n_shards - 1) / n_shards)
    cells = summed.select("text_key", "n", "offset", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    cells = cells.withColumn("n", before(F.col("offset") + F.col("n")) - before(F.col("offset")))
    return cells.select("text_key", "shard", "n").where("n > 0")


def _wishes(cells: DataFrame, closed: set[int], turn: int) -> DataFrame:
    """``text_key, shard, n, wish, gain`` of the cells that want to join the largest open one of their group."""
    tie = F.xxhash64("text_key", "shard", F.lit(turn))
    open_cells = cells.where(~F.col("shard").isin(sorted(closed))) if closed else cells
    best = open_cells.groupBy("text_key").agg(F.max(F.struct("n", tie.alias("tie"), "shard")).alias("best"))
    wishes = lookup_join(cells, best, "text_key").where("best is not null and shard <> best.shard and n <= best.n")
    return wishes.select("text_key", "shard", "n", F.col("best.shard").alias("wish"), F.col("best.n").alias("gain"))


def _kept(cells: DataFrame) -> int:
    """Links inside shards."""
    return int(cells.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)"))).head()[0] or 0)


def _load(cells: DataFrame, n_shards: int) -> list[int]:
    load = [0] * n_shards
    for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    return load


def dealt_anew(cells: DataFrame, capacity: list[int]) -> DataFrame:
    """The cells of groups in one shard as they are, those of other groups one group after the other into the room left."""
    sizes = cells.groupBy("text_key").agg(F.sum("n").alias("total"), (F.count(F.lit(1)) > 1).alias("split"))
    marked = staged(lookup_join(cells, sizes, "text_key"), "marked")
    whole = marked.where("not split").select("text_key", "shard", "n")
    load = _load(whole, len(capacity))
    ends = list(itertools.accumulate(c - n for c, n in zip(capacity, load, strict=True)))
    groups = marked.where("split").select("text_key", "total", F.struct((-F.col("total")).alias("total"), "text_key").alias("turn"))
    summed = running_sum(groups.distinct().withColumn("_all", F.lit(0)), "_all", "turn", F.col("total"), "offset")
    spans = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for s, (a, b) in enumerate(zip([0, *ends], ends, strict=False))))
    dealt = summed.select("text_key", "total", "offset", F.explode(spans).alias("s"))
    n = F.least(F.col("s.b"), F.col("offset") + F.col("total")) - F.greatest(F.col("s.a"), F.col("offset"))
    return whole.unionByName(dealt.select("text_key", F.col("s.shard").alias("shard"), n.alias("n")).where("n > 0"))


def settled(cells: DataFrame, capacity: list[int], history: list[int] | None = None) -> DataFrame:
    """Rounds, and rounds again from where split groups are dealt out anew, if that keeps more links."""
    first = propagate(cells, capacity, history)
    second = propagate(dealt_anew(first, capacity), capacity)
    kept = _kept(first), _kept(second)
    if history is not None:
        history.append(max(kept))
    return second if kept[1] > kept[0] else first


def propagate(cells: DataFrame, capacity: list[int], history: list[int] | None = None) -> DataFrame:
    """``cells(text_key, shard, n)`` after the rounds; ``history`` receives the links kept before each round."""
    cells, closed, turn = staged(cells, "cells"), set(), 0
    load = _load(cells, len(capacity))
    while True:
        if history is not None:
            history.append(_kept(cells))
        wishes = staged(_wishes(cells, closed, turn), "wishes")
        asked = {(r["shard"], r["wish"]): r["n"] for r in wishes.groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()}
        flow = granted(asked, load, capacity)
        moving = {pair: n for pair, n in flow.items() if n}
        for (i, j), n in moving.items():
            load[i], load[j] = load[i] - n, load[j] + n
        taking = {j for _, j in moving}
        refused = {j for _, j in asked} - taking
        before, closed = closed, {s for s in closed | refused if load[s] >= capacity[s] and s not in taking}
        if not moving:
            discard(wishes)
            if closed == before:
                return cells
            turn += 1
            continue
        pair = F.concat_ws(":", "shard", "wish")
        quota = F.create_map(*itertools.chain(*((F.lit(f"{i}:{j}"), F.lit(n)) for (i, j), n in moving.items())))
        ranked = wishes.select("*", pair.alias("pair"), F.struct((-F.col("gain")).alias("gain"), "text_key", "shard").alias("turn"))
        ranked = running_sum(ranked.where(pair.isin(list(f"{i}:{j}" for i, j in moving))), "pair", "turn", F.col("n"), "passed")
        count = F.least(F.col("n"), quota[F.col("pair")] - F.col("passed")).cast("bigint")
        moves = staged(ranked.select("text_key", "shard", "wish", count.alias("n")).where("n > 0"), "moves")
        after = cells.unionByName(moves.select("text_key", "shard", (-F.col("n")).alias("n"))).unionByName(
            moves.select("text_key", F.col("wish").alias("shard"), "n")
        )
        last, cells = cells, staged(after.groupBy("text_key", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        discard(last, wishes, moves)
        turn += 1


def assign(rows: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows(doc_id, text_key, ...)``; slots have no gaps within a shard."""
    split_hot_keys(rows.sparkSession)
    placed = numbered(rows, [F.col("text_key"), F.col("doc_id").asc_nulls_first()], "at")
    groups = placed.groupBy("text_key").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where(F.col("n") > 1), "groups")
    total = placed.count()
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = settled(dealt_cells(groups, n_shards), capacity)
    room = [c - n for c, n in zip(capacity, _load(cells, n_shards), strict=True)]
    # one entry per shard at most
    runs = cells.groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("shard").alias("label"), "n"))).alias("runs")
    )
    homes = groups.select("text_key", "start").join(runs, "text_key")
    found = staged(lookup_join(placed, homes, "text_key"), "homes")
    # a row of a group takes its place in the group's runs
    rank = F.col("at") - F.col("start")
    passed = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(-1).alias("label")),
        lambda s, r: F.struct(
            (s["end"] + r["n"]).alias("end"),
            F.when((s["label"] < 0) & (rank < s["end"] + r["n"]), r["label"]).otherwise(s["label"]).alias("label"),
        ),
    )
    linked = found.where(F.col("start").isNotNull()).withColumn("shard", passed["label"])
    # the others fill the shards up
    ends = list(itertools.accumulate(room))
    single = numbered(found.where(F.col("start").isNull()), [F.col("at")], "order")
    shard = F.size(F.filter(F.array(*(F.lit(e).cast("bigint") for e in ends)), lambda e: e <= F.col("order")))
    filled = single.withColumn("shard", shard.cast("int")).drop("order")
    columns = [*rows.columns, "shard"]
    every = linked.select(*columns).unionByName(filled.select(*columns))
    ordered = numbered(every, [F.col("shard"), F.col("doc_id").asc_nulls_first(), F.col("text_key")], "at")
    starts = [sum(capacity[:s]) for s in range(n_shards)]
    return ordered.withColumn("slot", F.col("at") - _at(starts, F.col("shard"))).drop("at")


def report(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("text_key"),
    )
    return assign(rows, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """``docs`` with two more columns, ``shard`` and ``slot``."""
    key, at = fresh(docs, "_text_key"), fresh(docs, "_at")
    order = [F.col("doc_id").asc_nulls_first(), F.col("_key")]
    homes = assign(docs.select("doc_id", text_key(F.col("text")).alias("text_key")), n_shards)
    # rows alike in id and text are told apart by their place in one order of both tables
    homes = numbered(homes.withColumnRenamed("text_key", "_key"), order, "at").select("at", "shard", "slot").alias("h")
    marked = docs.withColumn(key, text_key(F.col("text")))
    marked = numbered(marked, [F.col("doc_id").asc_nulls_first(), F.col(key)], at).alias("d")
    own = [F.col(f"d.{c}").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    joined = marked.join(homes, F.col(f"d.{at}") == F.col("h.at"))
    return joined.select(*own, F.col("h.shard").alias("shard"), F.col("h.slot").alias("slot"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """``links, kept, cut``: pairs of equal texts, in the same shard and not; of ``sharded(text_crc32, size, shard)``."""
    pairs = lambda c: (c * (c - 1) / 2).cast("bigint")
    cells = sharded.groupBy("text_crc32", "size", "shard").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("text_crc32", "size").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("kept"))
    sums = groups.agg(F.sum(pairs(F.col("n"))).alias("links"), F.sum("kept").alias("kept"))
    return sums.select("links", "kept", (F.col("links") - F.col("kept")).alias("cut"))
