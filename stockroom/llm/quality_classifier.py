"""Quality scores from a regularised quadratic discriminant.

Each class of labelled documents gets a normal density over transformed
document statistics. Its covariance is shrunk towards the common one and
towards a multiple of the identity, so it can be inverted whatever the number
of rows. A score is the logistic of the difference of the log densities; each
density comes from a Mahalanobis distance through a Cholesky factor that is
computed once, when the model is fitted.

Cases: a NULL or empty text has all statistics 0 and is scored like any other;
labels that are NULL, or whose document is missing, are not used; a label given
twice counts once, the lower value if they differ; documents given twice are
scored twice. With fewer than two labelled rows of a class every score is the
share of label 1 (0.5 without labels). Other columns of the documents are
ignored. Sums are taken over integers, so reruns agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm.words import blocks, bytes_of, word_block
from stockroom.shipping import map_in_arrow
from stockroom.staging import staged

#: Statistics are kept as integers of this unit.
UNIT = 10_000

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>{}[]\\^~_=+@/",
    "shout": b"!?",
    "stop": b".,;:",
}
#: Which class a byte belongs to; bytes above 127 are letters of other scripts and count as lower.
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _k
_CLASS_OF[128:] = list(_CLASSES).index("lower")

STATISTICS = ("words", "word_length", *_CLASSES, "distinct", "adjacent", "line_repeats", "line_words")


def _statistics(texts: pa.LargeStringArray) -> np.ndarray:
    """One row of transformed statistics per text, as integers."""
    raw, offsets = bytes_of(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    classes = len(_CLASSES) + 1
    counts = np.bincount(row * classes + _CLASS_OF[raw], minlength=n * classes).reshape(n, classes)[:, : len(_CLASSES)]
    block = word_block(texts)
    words = np.diff(block.first)
    word_row = np.repeat(np.arange(n), words)
    letters = np.bincount(word_row, weights=block.ends - block.starts, minlength=n)
    adjacent = np.zeros(n)
    if len(block.hashes) > 1:
        same = (block.hashes[1:] == block.hashes[:-1]) & (word_row[1:] == word_row[:-1])
        adjacent = np.bincount(word_row[1:], weights=same, minlength=n)
    order = np.lexsort((block.hashes, word_row))
    keyed, rows = block.hashes[order], word_row[order]
    new = np.ones(len(keyed), dtype=bool)
    new[1:] = (keyed[1:] != keyed[:-1]) | (rows[1:] != rows[:-1])
    distinct = np.bincount(rows, weights=new, minlength=n)
    lines = np.ones(n) + np.bincount(row, weights=raw == 10, minlength=n)
    repeats = np.zeros(n)
    for k, text in enumerate(texts.to_pylist()):
        if lines[k] > 1:
            every = text.split("\n")
            repeats[k] = len(every) - len(set(every))
    some, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    out = np.empty((n, len(STATISTICS)))
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(letters / some)
    out[:, 2 : 2 + len(_CLASSES)] = np.arcsin(np.sqrt(counts / size[:, None]))
    at = 2 + len(_CLASSES)
    out[:, at] = np.arcsin(np.sqrt(distinct / some)) * (words > 0)
    out[:, at + 1] = np.arcsin(np.sqrt(adjacent / some))
    out[:, at + 2] = np.arcsin(np.sqrt(repeats / lines))
    out[:, at + 3] = np.log1p(words / lines)
    return np.rint(out * UNIT).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            x = _statistics(batch.column("text"))
            columns = [pa.array(x[:, k]) for k in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *STATISTICS])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_in_arrow(rows, measure, "doc_id bigint, " + ", ".join(f"{s} bigint" for s in STATISTICS))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes; ``constant`` has the rest of the log ratio."""

    means: np.ndarray
    whiten: np.ndarray
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics in their own unit."""
        logit = np.full(len(x), self.constant)
        for sign, mean, whiten in zip((-0.5, 0.5), self.means, self.whiten, strict=True):
            logit -= sign * np.square((x - mean) @ whiten.T).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def fit(features: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on all labelled rows, from sums that Spark adds up per class.

    ``labels(doc_id, label)``. ``shrink`` is the share of the common covariance,
    ``ridge`` that of the identity. Only two rows of sums reach the driver.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    known = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    rows = features.join(known, "doc_id")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*(exact(F.col(s)) for s in STATISTICS)).alias("first"),
        F.array(*(exact(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i, j in pairs)).alias("second"),
    )
    found = {r["label"]: r for r in sums.collect()}
    n = np.array([found[k]["n"] if k in found else 0 for k in (0, 1)], dtype=float)
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), float(np.log(share / (1 - share))))
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        means[k] = np.array([float(v) for v in found[k]["first"]]) / n[k] / UNIT
        for (i, j), v in zip(pairs, found[k]["second"], strict=True):
            exact_sum = int(v) - int(found[k]["first"][i]) * int(found[k]["first"][j]) / int(n[k])
            scatter[k, i, j] = scatter[k, j, i] = float(exact_sum) / UNIT**2
    common = scatter.sum(axis=0) / (n.sum() - 2)
    whiten, constant = np.zeros_like(scatter), float(np.log(n[1] / n[0]))
    for k, sign in ((0, -1), (1, 1)):
        cov = (1 - shrink) * scatter[k] / (n[k] - 1) + shrink * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(common) / d, 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten[k] = np.linalg.inv(factor)
        constant -= sign * np.log(np.diag(factor)).sum()
    return Discriminant(means, whiten, constant)


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id`` and ``score``, from 0 to 1, of every row of statistics."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy() for s in STATISTICS]) / UNIT
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return map_in_arrow(features, rate, "doc_id bigint, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Is the row kept out of fitting?"""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; ``labels(doc_id, label)``.

    The statistics are written once: fitting and scoring both read them, not the texts.
    """
    features = staged(statistics(docs), "quality")
    model = fit(features, labels.where(~held_out(F.col("doc_id"))))
    return score(features, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
