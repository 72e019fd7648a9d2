"""One query per operator, over whole tables, and the SQL that some of them can be checked with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import (
    centroids,
    chat_format,
    decontamination,
    jaccard_join,
    mixing,
    near_vectors,
    pii_spans,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    token_files,
    whitening,
)
from stockroom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_labels(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(_read(spark, sf_dir, "documents"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, rowid_, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), test AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS length,
    words[i : i + least(len(words), 10) - 1] AS gram
  FROM item, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS r(i)
  WHERE len(words) > 0
), grams AS (SELECT DISTINCT length, gram FROM test), lengths AS (SELECT DISTINCT length FROM grams),
windows AS (
  SELECT rowid_, length, i, words[i : i + length - 1] AS gram
  FROM doc, lengths, unnest(range(1, len(words) - length + 2)) AS r(i)
), found AS (SELECT w.* FROM windows AS w JOIN grams USING (length, gram)),
hit AS (
  SELECT rowid_, count(DISTINCT p) AS n_hit
  FROM found, unnest(range(i, i + length)) AS r(p) GROUP BY rowid_
), listed AS (
  SELECT rowid_, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rowid_, item_id::VARCHAR AS item FROM found JOIN test USING (length, gram)) GROUP BY rowid_
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rowid_) LEFT JOIN listed USING (rowid_)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(_read(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read(spark, path))


#: A conversation whose texts consist of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    content = rows.withColumn("content", chat_format.text_part(F.coalesce(F.col("text"), F.lit(""))))
    back = chat_format.read_back(chat_format.format_conversations(content))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '[', '\b'), '<', '\l') AS safe_role,
    replace(replace(replace(text, '\', '\\'), '[', '\b'), '<', '\l') AS safe_text
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (7 + sum(length(safe_role) + length(safe_text) + 19))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, quality_labels(spark, sf_dir))
    return quality_rules.judge(docs, model)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii_spans.find(docs, pii_spans.fit(docs))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_read(spark, sf_dir, "embeddings"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(_read(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """``name -> fn(spark, sf_dir)``."""
    every = (
        op1_quality_classifier,
        op2_decontamination,
        op3_token_files,
        op4_sharding,
        op5_mixing,
        op6_chat_format,
        op7_quality_rules,
        op8_secret_scan,
        op9_pii,
        op10_jaccard_join,
        op11_whitening,
        op12_centroid_clustering,
        op13_near_vectors,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """``name -> SQL`` for DuckDB on the same tables."""
    return {"op2_decontamination": OP2_SQL, "op6_chat_format": OP6_SQL}
