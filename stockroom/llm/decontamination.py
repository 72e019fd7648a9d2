"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts are cut into words of digits, letters and all characters beyond ASCII;
A-Z count as a-z. Every run of ``WINDOW`` words of a test item is a window; a
shorter item is one window as a whole. The hashes of the distinct windows are
broadcast, behind a check of their number, and the hashes of all windows of the
documents are looked up in them. Documents with a hit are read again and their
words compared with the window's, so a hash collision is never reported.

Everything is DataFrame functions. The windows of a document are looked up as a
column of hashes; only hits leave their task. Where there are more test windows
than ``MAX_BROADCAST``, the same join is left to Spark without a hint.

Cases: a NULL or empty text has no words, is hit by nothing and hits nothing;
repeated rows are judged alike, as are repeated items; an id that is NULL is a
value like any other; two documents with the same id are told apart by their
texts; items with NULL as id hit but are not listed; with an empty benchmark
nothing is hit. ``remove`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.staging import fresh, staged

WINDOW = 10
#: Distinct test windows that are broadcast: about 16 bytes each.
MAX_BROADCAST = 1_000_000

# Fixed value: what separates words, once A-Z is lower case; the pattern for the text as it is.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, in their own case; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS, -1), "")


def lowered(words: Column) -> Column:
    """The words with A-Z in lower case, nothing else."""
    return F.transform(words, lambda w: F.translate(w, _UPPER, _LOWER))


def _hashes(words: Column) -> Column:
    """A hash per word that does not depend on the case of A-Z.

    ``lower`` changes further letters too, which can only make more windows
    look alike; words are compared afterwards.
    """
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _window_hashes(hashes: Column, n: Column, length: int) -> Column:
    """The hash of every run of ``length`` words."""
    none = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1)))
    return F.when(n >= length, F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, length)))).otherwise(none)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, length, hash, words`` of every distinct window of every item."""
    items = benchmark.select(
        F.col("item_id"), lowered(words_of(F.col("text").cast("string"))).alias("words")
    ).where(F.size("words") > 0)
    n = F.size("words")
    length = F.least(n, F.lit(window))
    cut = items.select(
        "item_id",
        length.alias("length"),
        F.explode(
            F.transform(F.sequence(F.lit(1), n - length + 1), lambda i: F.slice("words", i, length))
        ).alias("words"),
    )
    return cut.distinct().select("item_id", "length", F.xxhash64(_hashes(F.col("words"))).alias("hash"), "words")


def _small(keys: DataFrame, limit: int) -> DataFrame:
    """Narrow rows, to be broadcast if there are at most ``limit``."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def _candidates(docs: DataFrame, tests: DataFrame, max_broadcast: int) -> DataFrame:
    """``doc_id, print, start, length, hash`` where a document's window has the hash of a test window."""
    keys = tests.select("hash", "length").distinct()
    found = keys.groupBy("length").count().collect()  # a row per length: WINDOW rows at most
    lengths = sorted(r["length"] for r in found)
    keys = _small(keys, max_broadcast)
    hashed = docs.select("doc_id", "print", F.size("words").alias("n"), _hashes(F.col("words")).alias("hashes"))
    every = [_window_hashes(F.col("hashes"), F.col("n"), k) for k in lengths]
    none = F.array().cast("array<bigint>")
    spread = hashed.select(
        "doc_id", "print", "n", F.posexplode(F.concat(*every) if every else none).alias("at", "hash")
    )
    # windows of all lengths stand one after the other; take off those of the shorter ones
    start = F.lit(None).cast("int")
    for k in lengths:
        shorter = reduce(
            lambda a, b: a + b, (F.greatest(F.col("n") - j + 1, F.lit(0)) for j in lengths if j < k), F.lit(0)
        )
        start = F.when(F.col("length") == k, F.col("at") - shorter).otherwise(start)
    n_windows = F.greatest(F.col("n") - F.col("length") + 1, F.lit(0))
    return (
        spread.join(keys, "hash")
        .select("doc_id", "print", "length", "hash", "n", start.alias("start"))
        .where((F.col("start") >= 0) & (F.col("start") < n_windows))
        .drop("n")
    )


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST
) -> tuple[DataFrame, DataFrame]:
    """``doc_id, print, positions, windows`` of every document with a test window, and the test windows.

    ``positions`` are the hit words, from 0; ``print`` is the hash of the text.
    """
    tests = staged(windows(benchmark, window), "windows")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "print", F.xxhash64("text")
    )
    cut = texts.select("doc_id", "print", words_of(F.col("text")).alias("words"))
    found = _candidates(cut, tests, max_broadcast)
    asked = (
        found.join(tests.select("hash", "length", "words").distinct(), ["hash", "length"])
        .groupBy("doc_id", "print")
        .agg(F.collect_set(F.struct("start", "length", "words")).alias("asked"))
    )
    asked = staged(asked, "candidates")
    keys = _small(asked.select("doc_id", "print"), max_broadcast).alias("k")
    few = texts.alias("t").join(keys, _same("t", "k"), "left_semi").alias("t")
    pairs = F.array(F.struct(F.col("a.asked").alias("asked"), lowered(words_of(F.col("t.text"))).alias("words")))
    # the words are computed once for a document, not for every window that is asked for
    real = F.transform(
        pairs,
        lambda p: F.filter(
            p["asked"], lambda c: F.slice(p["words"], c["start"] + 1, c["length"]) == c["words"]
        ),
    )
    verified = few.join(asked.alias("a"), _same("a", "t")).select("t.doc_id", "t.print", F.flatten(real).alias("real"))
    verified = verified.where(F.size("real") > 0)
    spans = F.transform("real", lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1))
    result = verified.select(
        "doc_id",
        "print",
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("positions"),
        F.array_distinct(F.transform("real", lambda c: c["words"])).alias("windows"),
    )
    return staged(result.dropDuplicates(["doc_id", "print"]), "hits"), tests


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: its words, the hit ones, the items found and whether it is contaminated."""
    found, tests = hits(docs, benchmark, window, max_broadcast)
    items = (
        found.select("doc_id", "print", F.explode("windows").alias("words"))
        .join(tests.select("words", F.col("item_id").cast("string").alias("item")), "words")
        .groupBy("doc_id", "print")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .alias("i")
    )
    counts = found.select("doc_id", "print", F.size("positions").cast("bigint").alias("n_hit")).alias("h")
    every = docs.select(
        "doc_id",
        F.xxhash64(F.col("text").cast("string")).alias("print"),
        F.size(words_of(F.col("text").cast("string"))).cast("bigint").alias("n_words"),
    ).alias("d")
    with_items = counts.join(items, _same("h", "i"), "left").select("h.doc_id", "h.print", "h.n_hit", "i.items").alias("x")
    items_or_none = F.coalesce("x.items", F.array().cast("array<string>"))
    n_hit = F.coalesce("x.n_hit", F.lit(0).cast("bigint"))
    return every.join(with_items, _same("d", "x"), "left").select(
        "d.doc_id",
        "d.n_words",
        n_hit.alias("n_hit"),
        F.size(items_or_none).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_or_none, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _same(left: str, right: str) -> Column:
    """The same document on both sides; ids that are NULL are equal."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.print") == F.col(f"{right}.print")
    )


def remove(
    docs: DataFrame, benchmark: DataFrame, spans: bool = False, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST
) -> DataFrame:
    """``docs`` without the contaminated documents, or with ``spans`` without their hit words."""
    found, _ = hits(docs, benchmark, window, max_broadcast)
    gone = _small(found.select("doc_id", "print"), max_broadcast)
    mark, where = fresh(docs, "_print"), fresh(docs, "_positions")
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string"))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col(f"d.{mark}") == F.col("h.print"))
    if not spans:
        return marked.join(gone.alias("h"), same, "left_anti").drop(mark)
    text, gaps = F.col("text").cast("string"), F.split(F.col("text").cast("string"), _WORD, -1)
    words = F.regexp_extract_all(text, F.lit(f"({_WORD})"), 1)
    kept = F.transform(words, lambda w, k: F.when(F.array_contains(where, k), F.lit("")).otherwise(w))
    joined = F.concat(
        F.element_at(gaps, 1),
        F.array_join(F.zip_with(kept, F.slice(gaps, F.lit(2), F.size(gaps)), lambda w, g: F.concat(w, g)), ""),
    )
    positions = found.select("doc_id", "print", F.col("positions").alias(where)).alias("h")
    return (
        marked.join(positions, same, "left")
        .select(*(F.col(f"d.{c}").alias(c) for c in docs.columns), where)
        .withColumn("text", F.when(F.col(where).isNull(), F.col("text")).otherwise(joined))
        .drop(where)
    )
