"""From raw documents to a mixed and sharded corpus, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; the last adds ``shard`` and ``slot``.

Cases that hold for every stage: an empty input gives an empty output; extra
columns are kept; further cases stand with the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from stockroom.llm.queries import quality_labels
from stockroom.staging import staged

#: Near duplicates of the corpus: runs of five words, of which two documents share 80 %; op10 has its own measure.
NEAR_WIDTH, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep."""
    return quality_rules.retain(docs, quality_rules.fit(docs, quality_labels(spark, sf_dir)))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the lowest id, of each group of near duplicates."""
    return jaccard_join.first_of_each(docs, NEAR_PERCENT, NEAR_WIDTH)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for; repeated documents are repeated rows."""
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", keep_first_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A CRF, a similarity join and random rounding are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
