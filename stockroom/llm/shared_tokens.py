"""Candidates of a similarity join: groups whose prefixes share enough tokens.

Two groups are candidates if their prefixes share ``needed`` tokens, three but
for the smallest sets. Groups are listed under each token of their prefixes:

* A *short* list gives its pairs, filtered by size and by the place of the token.
  Pairs that enough short lists give are candidates.
* A *long* list gives no pairs. Its groups are looked at by size, in *spots* that
  hold two neighbouring classes of sizes each. In a spot, groups that share enough
  long lists with its first group, the hub, are tied to it: near copies of one
  text, which are verified together. If all are tied the spot is resolved.
* An unresolved list, as under a common phrase of otherwise different texts, is
  listed anew under two tokens, its own and each other one of the prefix, and if
  that is not enough under three. A pair that shares three tokens shares a list
  of each depth, so nothing is lost; a list under three tokens is tied as it is.

Postings are packed: a task sends one row per bucket of tokens, a task that
receives a bucket sorts it in place. Tokens known to be very common never enter
a bucket; they are long lists from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.words import mix
from stockroom.operators.joins import lookup_join
from stockroom.shipping import map_in_arrow, ship_package
from stockroom.staging import staged

#: Prefix tokens that linked sets share at least, if they are that large.
SHARED = 3
#: Groups under one token above which no pairs are made.
LONG_LIST = 64
#: Tokens known to be very common, at most.
MAX_HOT = 1 << 12
#: Postings that a task gathers before it sends them, and that a bucket holds about.
GATHERED, BUCKET = 1 << 17, 1 << 17

POSTING = np.dtype([("key", "<u4"), ("gid", "<i8"), ("n", "<i4"), ("at", "<i4")])
#: What a bucket gives: pairs a, b with the number of lists that they share and the size of the smaller; or groups a
#: with the hub b, the keys of the long lists that they share in a spot of the size class, and their size.
_FOUND = pa.schema(
    [
        ("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("n", pa.int64()), ("class", pa.int64()),
        ("keys", pa.list_(pa.int64())),
    ]
)
_FOUND_KINDS = "a bigint, b bigint, shared bigint, n bigint, class bigint, keys array<bigint>"

#: ``tokens, places`` of the postings of a prefix at some depth, given the keys to refine.
Listing = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class Measure(NamedTuple):
    """What links: ``percent`` of the union in common."""

    percent: int

    def overlap(self, n: int) -> int:
        """How much a set of ``n`` has in common with any set that it links with, at least."""
        return (self.percent * n + 99) // 100

    def needed(self, n: int) -> int:
        return min(SHARED, self.overlap(n))

    def prefix(self, n: int) -> int:
        """The tokens among which linked sets share at least the needed number."""
        return n - self.overlap(n) + self.needed(n)

    def needed_by(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(SHARED, (self.percent * n + 99) // 100)

    def needed_of(self, n: Column) -> Column:
        return F.least(F.lit(SHARED), F.floor((n * self.percent + 99) / 100)).cast("int")

    def prefix_of(self, n: Column) -> Column:
        return n - F.floor((n * self.percent + 99) / 100) + self.needed_of(n)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Sizes that may link are in the same or in neighbouring classes."""
        if self.percent >= 100:
            return n.astype(np.int64)
        return np.floor(np.log(n) / (1.0001 * math.log(100 / self.percent))).astype(np.int64)


def _combined(*tokens: np.ndarray) -> np.ndarray:
    """One token for several, in their order."""
    out = np.zeros_like(tokens[0])
    for t in tokens:
        out = mix((out ^ t) + np.uint64(0x9E3779B97F4A7C15))
    return out


def keys_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    """What is left of tokens in postings: the bucket and 32 bits. Others that share it only cost time."""
    return (tokens >> np.uint64(64 - bits) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def single(prefix: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return prefix, np.arange(len(prefix))


def _pairs_of(prefix: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``i < j`` of two tokens, one of them asked for, and the token for both; each once."""
    own = np.flatnonzero(np.isin(keys_of(prefix, bits), asked))
    other = np.arange(len(prefix))
    i, j = np.repeat(own, len(other)), np.tile(other, len(own))
    differ = i != j
    i, j = np.minimum(i, j)[differ], np.maximum(i, j)[differ]
    spot = np.unique(i * len(prefix) + j)
    i, j = spot // max(1, len(prefix)), spot % max(1, len(prefix))
    return i, j, _combined(prefix[i], prefix[j])


def double(prefix: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    _, j, tokens = _pairs_of(prefix, asked, bits)
    return tokens, j


def triple(prefix: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    i, j, tokens = _pairs_of(prefix, asked, bits)
    due = np.isin(keys_of(tokens, bits), asked)
    found, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in zip(i[due], j[due], strict=True):
        c = np.delete(np.arange(len(prefix)), [a, b])
        spots = np.sort(np.stack([np.full(len(c), a), np.full(len(c), b), c]), axis=0)
        found.append(_combined(*prefix[spots]))
        places.append(spots[2])
    tokens, first = np.unique(np.concatenate(found), return_index=True)
    return tokens, np.concatenate(places)[first]


def _prefixes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``gid, n, prefix, asked`` of every row."""
    column = batch.column("prefix")
    tokens = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    asked = batch.column("keys") if "keys" in batch.schema.names else None
    nothing = np.empty(0, np.uint64)
    for k, (gid, n) in enumerate(zip(batch.column("gid").to_pylist(), batch.column("n").to_pylist(), strict=True)):
        own = tokens[ends[k - 1] if k else 0 : ends[k]]
        yield gid, n, own, nothing if asked is None else np.sort(asked[k].values.to_numpy().view(np.uint64))


def _dealt(groups: DataFrame, listing: Listing, hot: np.ndarray, bits: int) -> DataFrame:
    """``bucket, postings``: packed postings; a task sends a group once, however often it meets it."""

    def sent(parts: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, names = np.concatenate(parts), np.concatenate(tokens)
        bucket = (names >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, bucket = every[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(every))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts].astype(np.int32)),
                pa.array([every[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ],
            ["bucket", "postings"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts, names, size = set(), [], [], 0
        for batch in batches:
            for gid, n, prefix, asked in _prefixes(batch):
                if gid in seen:
                    continue
                seen.add(gid)
                tokens, at = listing(prefix, asked, bits)
                if len(hot):
                    cold = ~np.isin(tokens, hot)
                    tokens, at = tokens[cold], at[cold]
                own = np.empty(len(tokens), POSTING)
                own["key"], own["gid"], own["n"], own["at"] = tokens & np.uint64(0xFFFFFFFF), gid, n, at
                parts.append(own)
                names.append(tokens)
                size += len(own)
                if size >= GATHERED:
                    yield from sent(parts, names)
                    parts, names, size = [], [], 0
        if size:
            yield from sent(parts, names)

    return map_in_arrow(groups, run, "bucket int, postings binary")


def _hot_rows(groups: DataFrame, hot: np.ndarray, bits: int, measure: Measure) -> DataFrame:
    """As the buckets, for the lists of very common tokens, which are long and meet in no task.

    The hubs of their spots are found first: ``hot`` has at most ``MAX_HOT`` tokens,
    and a token has a spot per size class, of which there are some hundred, so
    the table that goes to all tasks has a bound.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, int]]:
        seen = set()
        for batch in batches:
            for gid, n, prefix, _ in _prefixes(batch):
                if gid not in seen:
                    seen.add(gid)
                    yield gid, n, keys_of(prefix[np.isin(prefix, hot)], bits).view(np.int64), int(measure.size_class(np.array([n]))[0])

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: dict[tuple[int, int], list[int]] = {}
        for gid, n, keys, own in places(batches):
            for key in keys.tolist():
                for c in (own, own + 1):
                    spot = hubs.setdefault((key, c), [gid, gid, SHARED])
                    spot[0], spot[1], spot[2] = min(spot[0], gid), max(spot[1], gid), min(spot[2], measure.needed(n))
        rows = [(*spot, *facts) for spot, facts in hubs.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "class", "hub", "top", "needed"])

    hubs = map_in_arrow(groups, lowest, "key bigint, class bigint, hub bigint, top bigint, needed bigint").groupBy("key", "class")
    table = hubs.agg(F.min("hub"), F.max("top"), F.min("needed")).toArrow().to_pydict()
    known = {(k, c): (hub, top, needed) for k, c, hub, top, needed in zip(*table.values(), strict=True)}
    shared = groups.sparkSession.sparkContext.broadcast(known)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = shared.value
        rows: list[tuple] = []
        for gid, n, keys, own in places(batches):
            by_hub: dict[tuple[int, int], list[int]] = {}
            for key in keys.tolist():
                for c in (own, own + 1):
                    hub, top, needed = spots[key, c]
                    if hub == top:
                        continue
                    if needed <= 1:  # what shares this token is to be compared
                        rows.append((gid, hub, SHARED, n, None, None))
                    else:
                        by_hub.setdefault((hub, c), []).append(key)
            rows += [(gid, hub, None, n, c, own_keys) for (hub, c), own_keys in by_hub.items()]
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    # a group that several tasks meet gives the same rows in each
    return map_in_arrow(groups, tie, _FOUND_KINDS).dropDuplicates(["a", "b", "class"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)


def _pairs(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, measure: Measure) -> Iterator[np.ndarray]:
    """``a, b, least`` of the pairs of short lists that size and place allow."""
    percent = measure.percent
    for length in np.unique(lengths):
        i, j = np.triu_indices(length, 1)
        own = starts[lengths == length]
        step = max(1, (1 << 18) // len(i))
        for begin in range(0, len(own), step):
            first = own[begin : begin + step, None]
            a, b = rows[(first + i).ravel()], rows[(first + j).ravel()]
            small, large = np.minimum(a["n"], b["n"]).astype(np.int64), np.maximum(a["n"], b["n"]).astype(np.int64)
            # in common from this token on; it may be the third common one
            most = np.minimum(a["n"] - a["at"], b["n"] - b["at"]).astype(np.int64)
            both = a["n"].astype(np.int64) + b["n"]
            may = (small * 100 >= large * percent) & ((most + SHARED - 1) * (100 + percent) >= both * percent)
            yield np.stack([a["gid"][may], b["gid"][may], small[may]], axis=1)


def _in_spots(rows: np.ndarray, bucket: int, measure: Measure, depth: int) -> pa.Table:
    """Long lists by spots: what is to be compared at once, and per group and hub the keys that they share."""
    twice = np.concatenate([rows, rows])
    size_class = measure.size_class(rows["n"])
    size_class = np.concatenate([size_class, size_class + 1])
    order = np.lexsort((twice["gid"], size_class, twice["key"]))
    twice, size_class = twice[order], size_class[order]
    begins = np.ones(len(twice), dtype=bool)
    begins[1:] = (twice["key"][1:] != twice["key"][:-1]) | (size_class[1:] != size_class[:-1])
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(twice)))
    hub = np.repeat(twice["gid"][starts], sizes)
    needed = np.repeat(np.minimum.reduceat(measure.needed_by(twice["n"].astype(np.int64)), starts), sizes)
    several = np.repeat(sizes > 1, sizes)
    # sharing this list is all that can be asked
    final = several & (needed <= depth)
    ties = np.unique(np.stack([twice["gid"], hub, twice["n"]], axis=1)[final & (twice["gid"] != hub)], axis=0)
    m = len(ties)
    parts = [
        pa.table([pa.array(ties[:, 0]), pa.array(ties[:, 1]), pa.array(np.full(m, SHARED)), pa.array(ties[:, 2]), pa.nulls(m, pa.int64()), pa.nulls(m, _FOUND.field("keys").type)], schema=_FOUND)
    ]
    keep = several & ~final
    rows, size_class, hub = twice[keep], size_class[keep], hub[keep]
    order = np.lexsort((rows["key"], size_class, hub, rows["gid"]))
    rows, size_class, hub = rows[order], size_class[order], hub[order]
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = (rows["gid"][1:] != rows["gid"][:-1]) | (hub[1:] != hub[:-1]) | (size_class[1:] != size_class[:-1])
    starts = np.flatnonzero(begins)
    keys = pa.ListArray.from_arrays(
        pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(bucket | rows["key"].astype(np.int64))
    )
    first = rows[starts]
    return pa.concat_tables(
        [*parts, pa.table([pa.array(first["gid"]), pa.array(hub[starts]), pa.nulls(len(first), pa.int64()), pa.array(first["n"].astype(np.int64)), pa.array(size_class[starts]), keys], schema=_FOUND)]
    )


def _looked_through(measure: Measure, depth: int, long_list: int) -> Callable[[pa.Table], pa.Table]:
    def look(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, POSTING) for x in table.column("postings").to_pylist()])
        rows = rows[np.lexsort((rows["gid"], rows["key"]))]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["gid"][1:] != rows["gid"][:-1])
        rows = rows[fresh]
        starts = np.flatnonzero(np.diff(rows["key"].astype(np.int64), prepend=-1))
        lengths = np.diff(np.append(starts, len(rows)))
        short = (lengths > 1) & (lengths <= long_list)
        pairs = np.concatenate([np.empty((0, 3), np.int64), *_pairs(rows, starts[short], lengths[short], measure)])
        pairs, shared = np.unique(pairs, axis=0, return_counts=True)
        m = len(pairs)
        found = pa.table([*map(pa.array, (pairs[:, 0], pairs[:, 1], shared.astype(np.int64), pairs[:, 2])), pa.nulls(m, pa.int64()), pa.nulls(m, _FOUND.field("keys").type)], schema=_FOUND)
        long = rows[np.repeat(lengths > long_list, lengths)]
        if not len(long):
            return found
        return pa.concat_tables([found, _in_spots(long, table.column("bucket")[0].as_py() << 32, measure, depth)])

    return look


def _judged(long: DataFrame, measure: Measure, depth: int) -> tuple[DataFrame, DataFrame]:
    """Ties ``a, b`` of groups that share enough with their hub, and ``gid, keys`` of the places in lists where some do not.

    A group and its hub share no more keys than a prefix has tokens, and a hub
    is in all of its lists, so all arrays here are that short.
    """
    common = long.groupBy("a", "b", "class").agg(F.flatten(F.collect_list("keys")).alias("keys"), F.max("n").alias("n"))
    common = staged(common, "common")
    enough = F.size("keys") >= measure.needed_of(F.col("n")) - (depth - 1)
    apart = F.col("a") != F.col("b")
    ties = common.where(apart & enough).select("a", "b").distinct()
    hub = F.struct("b", "class")
    few = common.where(apart & ~enough).select(hub.alias("hub"), F.explode("keys").alias("key"))
    open_keys = few.groupBy("hub").agg(F.collect_set("key").alias("open"))
    placed = lookup_join(common.select("a", "keys", hub.alias("hub")), open_keys, "hub")
    open_places = placed.select(F.col("a").alias("gid"), F.array_intersect("keys", "open").alias("keys"))
    return ties, open_places.where(F.size("keys") > 0)


def _bits(postings: int) -> int:
    return max(6, math.ceil(math.log2(max(1, postings) / BUCKET)))


def candidates(groups: DataFrame, percent: int, hot: np.ndarray, long_list: int = LONG_LIST) -> DataFrame:
    """``a, b``: ties of groups whose closure holds all pairs that may link.

    ``groups(gid, n, prefix)`` may hold a group several times. ``hot``: sorted tokens known to be very common.
    """
    measure = Measure(percent)
    ship_package(groups.sparkSession)
    found: list[DataFrame] = []
    rows, asked, bits = groups, None, 0
    for depth, listing in enumerate((single, double, triple), start=1):
        if asked is not None:
            keys = asked.groupBy("gid").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
            once = groups.join(asked.select("gid").distinct(), "gid", "left_semi").dropDuplicates(["gid"])
            rows = staged(once.join(keys, "gid"), "refined")
        if not bits:
            bits = _bits(groups.agg(F.sum(measure.prefix_of(F.col("n")))).head()[0] or 0)
        dealt = _dealt(rows, listing, hot if depth == 1 else hot[:0], bits)
        look = _looked_through(measure, depth, long_list)
        lists = staged(dealt.groupBy("bucket").applyInArrow(look, _FOUND_KINDS), "lists")
        enough = measure.needed_of(F.col("n")) if depth == 1 else F.lit(1)
        pairs = lists.where(F.col("keys").isNull())
        long = lists.where(F.col("keys").isNotNull())
        if depth == 1 and len(hot):
            common = staged(_hot_rows(rows, hot, bits, measure), "hot")
            pairs = pairs.unionByName(common.where(F.col("keys").isNull()))
            long = long.unionByName(common.where(F.col("keys").isNotNull()))
        pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("n").alias("n"))
        found.append(pairs.where((F.col("shared") >= enough) & (F.col("a") != F.col("b"))).select("a", "b"))
        if long.isEmpty():
            break
        ties, open_places = _judged(long, measure, depth)
        found.append(ties)
        open_places = staged(open_places, "open")
        if open_places.isEmpty():
            break
        asked = open_places if asked is None else asked.unionByName(open_places)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
