"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order, NULL last, weigh 1, 2, 3, repeating. Targets share
all words by weight; a source that would exceed ``MAX_REPEAT`` times its size
stops there and the others share the rest. Every document of a source is then
wanted ``target / size`` times, its *share*, of which a part is a fraction of a
copy.

Fractional copies are rounded in pairs: a document, and the rest of its group
taken together. The two exchange words at random, without bias, until the
document's copies are a whole number, the next one below or above its share; the
words of the pair stay the same, and the rest shares its gain or loss evenly,
between no copy and ``MAX_REPEAT`` of each. Every document is taken as often as
its share says on average. Documents go from
the largest to the smallest. First the ``HEAD`` largest documents of a source
are paired with all the rest of it, which only its two sums stand for, so a
document that is large against its bucket finds a partner that can bear it.
The others are dealt into buckets of about ``BUCKET`` of all sizes; each leaves
at most one fraction, and the fractions are again dealt into buckets, up a tree,
until one is left, which is rounded by itself. So the words taken from a source
differ from its target by less than the document that is left, one of the
smallest of the last bucket, unless a document is so large that all others
together cannot bear its fraction.

Everything is DataFrame functions; randomness is a hash of the position and the
seed, so reruns agree. No task holds more than a bucket.

Cases: a NULL or empty text has size 0 and takes no words; repeated rows are
rounded each by itself; ties in size go by id and text; sources without words
have target 0; an empty table gives an empty result. ``mix`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.operators.numbering import numbered
from stockroom.session import split_hot_keys
from stockroom.staging import staged

MAX_REPEAT = 3
BUCKET = 64
#: The largest documents of a source, which are rounded before the others.
HEAD = 64
WEIGHTS = 3


def size_of(text: Column) -> Column:
    """The number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(rows: DataFrame) -> DataFrame:
    """``source, source_size, first, rows, target`` of every source of ``rows(source, size, _at)``.

    Rows are aggregated by source before they are shuffled. What remains is one
    row per source, and the two windows without a key run over those only.
    """
    sums = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("_at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("weight", ((F.row_number().over(by_name) - 1) % WEIGHTS + 1).cast("double"))
    # The sources that reach their limit are those with the lowest limit per weight. A source stops
    # if its share of what those before it leave, by weight among the rest, is above its limit.
    limit = F.col("source_size") * MAX_REPEAT
    by_room = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = weighed.select("*", (left / weight_left).alias("rate"), limit.alias("limit"))
    # the first source that stays below its limit sets the rate for all that follow
    stays = F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rate"))
    rate = F.min(stays).over(whole)["rate"]
    target = F.least(F.coalesce(rate * F.col("weight"), F.col("limit")), F.col("limit")).cast("double")
    return shared.select("source", "source_size", "first", "rows", target.alias("target"))


def _uniform(*what: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


#: A document in a bucket: its words, its place, the words that are still wanted of it, and its random number.
_DOC = "struct<size: bigint, place: bigint, wanted: double, random: double>"
_DECISIONS = "array<struct<place: bigint, copies: int>>"
#: What is left of a bucket: the words of the documents to come, and those wanted of them. Their share
#: is scale * (share at first) + shift, for every one of them alike.
_STATE = f"struct<size: bigint, wanted: double, scale: double, shift: double, open: {_DOC}, decided: {_DECISIONS}>"
#: A share this close to a whole number is one.
_CLOSE = 1e-9


def _document(size: Column, place: Column, wanted: Column, random: Column) -> Column:
    named = (size.alias("size"), place.alias("place"), wanted.alias("wanted"), random.alias("random"))
    return F.struct(*named).cast(_DOC)


def _with(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of some values, each computed once however often ``body`` uses it."""
    named = F.struct(*(value.alias(name) for name, value in values.items()))
    return F.transform(F.array(named), body)[0]


def _pair(state: Column, doc: Column) -> Column:
    """Let a document exchange words with the rest of its bucket."""
    size, rest_size = doc["size"], state["size"] - doc["size"]
    share = state["scale"] * (doc["wanted"] / size) + state["shift"]
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(float(MAX_REPEAT)))

    def places(v: Column) -> Column:
        below = F.floor(v["share"] + _CLOSE).cast("double")
        return _with({"share": v["share"], "below": below, "settled": v["share"] - below <= _CLOSE}, sums)

    def sums(v: Column) -> Column:
        wanted = F.when(v["settled"], v["below"] * size).otherwise(v["share"] * size)
        return _with({"below": v["below"], "settled": v["settled"], "wanted": wanted}, rests)

    def rests(v: Column) -> Column:
        rest = F.least(F.greatest(state["wanted"] - v["wanted"], F.lit(0.0)), (rest_size * MAX_REPEAT).cast("double"))
        kept = {c: v[c] for c in ("below", "settled", "wanted")}
        more, less = (v["below"] + 1) * size - v["wanted"], v["wanted"] - v["below"] * size
        return _with({**kept, "rest": rest, "more": more, "less": less}, moves)

    def moves(v: Column) -> Column:
        room = rest_size * MAX_REPEAT - v["rest"]
        kept = {c: v[c] for c in ("below", "settled", "wanted", "rest", "more", "less")}
        return _with({**kept, "room": room, "take": F.least(v["rest"], v["more"]), "give": F.least(room, v["less"])}, draws)

    def draws(v: Column) -> Column:
        alone = (v["rest"] <= 0) | (v["room"] <= 0)  # the last one, or the others can give or take no more
        free = ~v["settled"] & ~alone
        up = doc["random"] * (v["give"] + v["take"]) < v["give"]
        kept = {c: v[c] for c in ("below", "settled", "wanted", "rest", "more", "less", "room", "take", "give")}
        return _with({**kept, "gains": free & up, "loses": free & ~up}, ends)

    def ends(v: Column) -> Column:
        up = v["gains"] & (v["take"] == v["more"])
        down = v["settled"] | (v["loses"] & (v["give"] == v["less"]))
        after = F.when(v["gains"], v["wanted"] + v["take"]).when(v["loses"], v["wanted"] - v["give"]).otherwise(v["wanted"])
        # the rest has lost the part `lost` of its words, or won the part `won` of its room
        lost = F.when(v["gains"], F.when(v["take"] == v["rest"], F.lit(1.0)).otherwise(v["take"] / v["rest"]))
        won = F.when(v["loses"], F.when(v["give"] == v["room"], F.lit(1.0)).otherwise(v["give"] / v["room"]))
        zero = F.lit(0.0)
        facts = {"up": up, "done": up | down, "after": after, "lost": F.coalesce(lost, zero), "won": F.coalesce(won, zero)}
        return _with({**facts, **{c: v[c] for c in ("below", "rest", "room")}}, outcome)

    def outcome(v: Column) -> Column:
        keep = (1 - v["lost"]) * (1 - v["won"])
        whole = (v["below"] + v["up"].cast("double")).cast("int")
        decision = F.array(F.struct(doc["place"].alias("place"), whole.alias("copies"))).cast(_DECISIONS)
        return F.struct(
            rest_size.alias("size"),
            (v["rest"] * (1 - v["lost"]) + v["room"] * v["won"]).alias("wanted"),
            (state["scale"] * keep).alias("scale"),
            (state["shift"] * keep + v["won"] * MAX_REPEAT).alias("shift"),
            F.when(v["done"], state["open"]).otherwise(_document(size, doc["place"], v["after"], doc["random"])).alias("open"),
            F.when(v["done"], F.concat(state["decided"], decision)).otherwise(state["decided"]).alias("decided"),
        ).cast(_STATE)

    return _with({"share": share}, places)


def _state(size: Column, wanted: Column) -> Column:
    return F.struct(
        size.cast("bigint").alias("size"),
        wanted.cast("double").alias("wanted"),
        F.lit(1.0).alias("scale"),
        F.lit(0.0).alias("shift"),
        F.lit(None).cast(_DOC).alias("open"),
        F.array().cast(_DECISIONS).alias("decided"),
    ).cast(_STATE)


def _head(fractions: DataFrame) -> DataFrame:
    """Round the ``HEAD`` largest of ``fractions(first, source_size, target, doc)`` against all the rest of their source.

    Returns ``first, share, open, decided``: the share of every document of the rest, the same for all.
    """
    docs = F.reverse(F.array_sort(F.collect_list("doc"))).alias("docs")
    heads = fractions.groupBy("first").agg(docs, F.max("source_size").alias("size"), F.max("target").alias("target"))
    state = heads.select("first", F.aggregate("docs", _state(F.col("size"), F.col("target")), _pair).alias("s"))
    share = F.when(F.col("s.size") > 0, F.col("s.wanted") / F.col("s.size"))
    return state.select("first", share.alias("share"), "s.open", "s.decided")


def _round(fractions: DataFrame) -> DataFrame:
    """Round inside the buckets of ``fractions(first, buckets, bucket, doc)``.

    Returns ``first, buckets, bucket, open, decided``; a bucket holds ``BUCKET`` rows at most.
    """
    total = lambda field, zero: F.aggregate("docs", zero, lambda s, d: s + d[field])
    start = _state(total("size", F.lit(0).cast("bigint")), total("wanted", F.lit(0.0)))
    return (
        fractions.groupBy("first", "buckets", "bucket")
        .agg(F.reverse(F.array_sort(F.collect_list("doc"))).alias("docs"))
        .select("first", "buckets", "bucket", F.aggregate("docs", start, _pair).alias("s"))
        .select("first", "buckets", "bucket", "s.open", "s.decided")
    )


def _itself(left: DataFrame) -> DataFrame:
    """``place, copies`` of fractions that nothing is left to pair with."""
    share = F.col("open.wanted") / F.col("open.size")
    copies = F.floor(share) + (F.col("open.random") < share - F.floor(share)).cast("int")
    return left.select("open.place", copies.cast("int").alias("copies"))


def _buckets(rows: Column) -> Column:
    return F.ceil(rows / BUCKET).cast("bigint")


def _placed(rows: DataFrame, kept: str | None = None) -> DataFrame:
    """``rows(doc_id, source, size, print)`` with ``_at``, their place by source and size; ``kept`` is carried along."""
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id"), F.col("print")]
    return numbered(rows.select("doc_id", "source", "size", "print", *([kept] if kept else [])), order, "_at")


def copies(placed: DataFrame, seed: int = 7) -> DataFrame:
    """How often each row of ``placed(_at, doc_id, source, size, ...)`` is taken.

    Adds ``source_size, target, copies``; the rows come back with their columns.
    """
    found = staged(targets(placed), "targets")
    # a row per source: broadcast by Spark where that is small
    joined = placed.join(found.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows_with = staged(joined, "wanted")
    place = F.col("_at") - F.col("first")
    fractions = rows_with.where((F.col("target") > 0) & (F.col("size") > 0))
    random = _uniform(F.lit(seed), F.lit(0), F.col("doc_id"), F.col("_at"))
    largest = place >= F.col("rows") - HEAD
    share = F.col("target") / F.col("source_size")
    doc = _document(F.col("size"), F.col("_at"), share * F.col("size"), random)
    heads = staged(_head(fractions.where(largest).select("first", "source_size", "target", doc.alias("doc"))), "heads")
    parts = [heads.select(F.explode("decided").alias("d")).select("d.*"), _itself(heads.where("open is not null"))]
    open_rows = fractions.where(~largest).join(heads.select("first", "share"), "first").select(
        "first",
        _buckets(F.col("rows")).alias("buckets"),
        (place % _buckets(F.col("rows"))).alias("bucket"),
        _document(F.col("size"), F.col("_at"), F.col("share") * F.col("size"), random).alias("doc"),
    )
    level = 0
    while True:
        level += 1
        result = staged(_round(open_rows), "rounding")
        parts.append(result.select(F.explode("decided").alias("d")).select("d.*"))
        left = result.where(F.col("open").isNotNull())
        if left.agg(F.max("buckets")).collect()[0][0] in (None, 1):
            parts.append(_itself(left))  # one fraction per source
            break
        open_rows = left.select(
            "first",
            _buckets(F.col("buckets")).alias("buckets"),
            (F.col("bucket") % _buckets(F.col("buckets"))).alias("bucket"),
            _document(
                F.col("open.size"),
                F.col("open.place"),
                F.col("open.wanted"),
                _uniform(F.lit(seed), F.lit(level), F.col("open.place")),
            ).alias("doc"),
        )
    decided = reduce(DataFrame.unionByName, parts).withColumnRenamed("place", "_place")
    result = rows_with.join(decided, F.col("_at") == F.col("_place"), "left")
    # rows without words are rounded down
    whole = F.coalesce("copies", F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int")
    return result.withColumn("copies", whole).drop("_place", "first", "rows")


def report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    split_hot_keys(docs.sparkSession)
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("print"))
    return copies(_placed(rows), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken."""
    split_hot_keys(docs.sparkSession)
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("_row")
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("print"), whole)
    placed = _placed(rows, "_row")
    taken = copies(placed.drop("_row"), seed).where(F.col("copies") > 0).select("_at", "copies")
    again = placed.select("_at", "_row").join(taken, "_at").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select("_row.*")
