"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "print string, _print bigint, size int, shard string, copies int"
)
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen. "
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(20_000))


def _row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None, "x", 1, 2, "y", 3)


ROWS = [
    _row(1, None),
    _row(2, ""),
    _row(3, " \t\n\x0b\x0c\r "),
    _row(4, PROSE * 3),
    _row(5, PROSE * 3),
    _row(5, PROSE * 3),
    _row(6, (PROSE * 3).upper(), None),
    _row(7, LONG, "b"),
    _row(8, LONG + " tail", "b"),
    _row(None, "no id here"),
    _row(None, None, None),
    _row(9, "\x00 naïve Ünïcode   nb-space ΣΑΣ J̌ <|endoftext|> <|EndOfText|> 漢字 👩‍👩", "c"),
    _row(10, "a", "c"),
    _row(11, "b a", "c"),
    _row(12, "same line here\nsame line here\n\nsame line here", "c"),
    _row(13, "spam " * 400, "c"),
    _row(14, "x" * 100_000, "d"),
    _row(-5, "dup id one", "d"),
    _row(-5, "dup id two", "d"),
]


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=repr)
