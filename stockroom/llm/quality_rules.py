"""Line-level quality rules: a linear-chain CRF marks each line as content or boilerplate.

A line is described by a handful of yes/no features; the CRF scores a label by
the features of its line and by the label of the line before, and Viterbi
decoding finds the best sequence for the whole document. The share of bytes in
content lines decides whether the document is kept, after two plain counts that
reject it outright (too few words, too many words in repeated windows).

The weights are fitted to the labelled documents: every line takes the label of
its document, and the chain learns which features tell and how labels stick
together. ``max_docs`` labelled documents, the first by a hash of their id,
bound what the driver receives: one small integer per line. Without labels of
both kinds ``DEFAULT`` is used.

Cases: a NULL or empty text has no words and fails; lines without a word have
no label and do not count; rows given twice are judged twice; labels that are
NULL are ignored and the lower of two is taken. Extra columns are kept by
``retain`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.words import Block, blocks, window_hashes, word_block
from stockroom.shipping import map_in_arrow

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_ENDINGS = b".!?\"':;)"

FEATURES = (
    "symbols", "shouts", "capitals", "repeats itself", "short", "no full stop", "digits", "seen before", "bars", "long",
)


def line_code(line: bytes, seen: bool) -> int:
    """The features of a line, as bits in the order of ``FEATURES``."""
    words = line.split()
    n, again = len(words), sum(map(eq, words, words[1:]))
    size = sum(map(len, words))
    count = lambda some: len(line) - len(line.translate(None, some))
    tests = (
        count(_SYMBOLS) * 10 >= size,
        count(b"!?") * 20 >= size,
        count(_UPPER) * 2 > size,
        again * 4 >= n,
        n < 4,
        words[-1][-1] not in _ENDINGS,
        count(_DIGITS) * 5 >= size,
        seen,
        words.count(b"|") * 5 >= n,
        n >= 100,
    )
    return sum(1 << k for k, yes in enumerate(tests) if yes)


def _lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip()]


def line_codes(lines: list[bytes]) -> list[int]:
    """The code of every line of a document that has a word."""
    seen: set[bytes] = set()
    codes = []
    for line in lines:
        codes.append(line_code(line, line in seen))
        seen.add(line)
    return codes


@dataclass(frozen=True)
class LineCrf:
    """``content[k]``: what feature k adds to the score of *content*; labels are 0 boilerplate, 1 content."""

    bias: float
    content: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]

    def emissions(self) -> np.ndarray:
        """The score of *content* over *boilerplate* for every code."""
        codes = np.arange(1 << len(FEATURES))
        bits = (codes[:, None] >> np.arange(len(FEATURES))) & 1
        return self.bias + bits @ np.array(self.content)


#: For corpora without labels.
DEFAULT = LineCrf(2.0, (-4.0, -3.0, -3.0, -4.0, -0.5, -0.5, -1.0, -3.0, -4.0, 0.0), ((1.0, -1.0), (-1.0, 1.0)))


def viterbi(scores: list[float], step: tuple[tuple[float, float], tuple[float, float]]) -> list[int]:
    """The best labels of a chain; ties go to content."""
    (s00, s01), (s10, s11) = step
    if scores and min(scores) >= 0 and s11 >= max(s00, s01, s10):
        return [1] * len(scores)  # every term of this path is the largest there is
    best0, best1 = 0.0, scores[0] if scores else 0.0
    back = []
    for score in scores[1:]:
        from0 = best1 + s10 >= best0 + s00
        from1 = best1 + s11 >= best0 + s01
        back.append((from0, from1))
        best0, best1 = (best1 + s10 if from0 else best0 + s00), (best1 + s11 if from1 else best0 + s01) + score
    label = int(best1 >= best0)
    labels = [label]
    for step_back in reversed(back):
        label = int(step_back[label])
        labels.append(label)
    return labels[::-1] if scores else []


def _fit_chains(chains: list[np.ndarray], labels: np.ndarray, rounds: int = 150) -> LineCrf:
    """Maximise the regularised likelihood of the chains by Adam; each chain has one label for all its lines."""
    k, n = len(FEATURES), len(chains)
    width = max(map(len, chains))
    codes = np.zeros((n, width), dtype=np.int64)
    mask = np.zeros((n, width), dtype=bool)
    for i, chain in enumerate(chains):
        codes[i, : len(chain)], mask[i, : len(chain)] = chain, True
    bits = ((codes[:, :, None] >> np.arange(k)) & 1).astype(float)
    theta = np.zeros(k + 5)  # bias, features, steps
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    gold = np.zeros((2, 2))
    for y in (0, 1):
        gold[y, y] = both[labels == y].sum()
    weight = mask.sum()
    for turn in range(1, rounds + 1):
        emit = np.zeros((n, width, 2))
        emit[:, :, 1] = theta[0] + bits @ theta[1 : k + 1]
        step = theta[k + 1 :].reshape(2, 2)
        ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, width):
            go = np.logaddexp(ahead[:, t - 1, :1] + step[0], ahead[:, t - 1, 1:] + step[1]) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], go, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            after = emit[:, t + 1] + behind[:, t + 1]
            go = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
            behind[:, t] = np.where(mask[:, t + 1, None], go, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])[:, None]
        content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total) * mask
        miss = (labels[:, None] * mask) - content
        gradient = np.zeros_like(theta)
        gradient[0] = miss.sum()
        gradient[1 : k + 1] = np.einsum("nt,ntk->k", miss, bits)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                pair = ahead[:, :-1, a] + step[a, b] + emit[:, 1:, b] + behind[:, 1:, b] - total
                expected[a, b] = np.exp(pair[both]).sum()
        gradient[k + 1 :] = (gold - expected).ravel()
        gradient = gradient / weight - 1e-3 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    theta = np.round(theta, 6)
    return LineCrf(
        float(theta[0]),
        tuple(map(float, theta[1 : k + 1])),
        ((float(theta[k + 1]), float(theta[k + 2])), (float(theta[k + 3]), float(theta[k + 4]))),
    )


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, chain: int = 64) -> LineCrf:
    """Fit the CRF to at most ``max_docs`` labelled documents of each label; ``labels(doc_id, label)``.

    Their lines are all used, in chains of up to ``chain`` lines.
    """
    known = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    taken = None
    for y in (0, 1):
        some = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        taken = some if taken is None else taken.unionByName(some)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = []
            for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                all_codes = line_codes(_lines(text.encode()))
                found += [
                    (doc, label, k, all_codes[k : k + chain]) for k in range(0, len(all_codes), chain)
                ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "label", "at", "codes"), x, strict=True)) for x in found], schema=_CODES
            )

    found = map_in_arrow(rows, codes, "doc_id bigint, label int, at int, codes array<smallint>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["at"], r["codes"]))
    found_labels = np.array([r["label"] for r in found], dtype=np.int64)
    if len(set(found_labels.tolist())) < 2:
        return DEFAULT
    return _fit_chains([np.array(r["codes"], dtype=np.int64) for r in found], found_labels)


_CODES = pa.schema(
    [("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.int32()), ("codes", pa.list_(pa.int16()))]
)


def _repeat_words(block: Block, n: int) -> np.ndarray:
    """For each text, the words that lie in windows found twice or more in it."""
    out = np.zeros(n, dtype=np.int64)
    hashes, row = window_hashes(block, REPEAT_WINDOW)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    twice = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    for k in np.unique(r[1:][twice]):  # only these texts can repeat a window; compare their words
        a, b = block.first[k], block.first[k + 1]
        data = block.raw
        words = [data[s:e].tobytes() for s, e in zip(block.starts[a:b], block.ends[a:b], strict=True)]
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words]
        windows = [tuple(ids[i : i + REPEAT_WINDOW]) for i in range(len(ids) - REPEAT_WINDOW + 1)]
        found: dict[tuple, int] = {}
        for w in windows:
            found[w] = found.get(w, 0) + 1
        mark = np.zeros(len(ids) + 1, dtype=np.int64)
        for i, w in enumerate(windows):
            if found[w] > 1:
                mark[i] += 1
                mark[i + REPEAT_WINDOW] -= 1
        out[k] = np.count_nonzero(np.cumsum(mark[:-1]) > 0)
    return out


_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


class _Judge:
    """Counts and verdicts for a block of texts."""

    def __init__(self, model: LineCrf) -> None:
        self.emit = model.emissions().tolist()
        self.step = model.step

    def __call__(self, texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
        n = len(texts)
        block = word_block(texts)
        row = np.repeat(np.arange(n), np.diff(block.offsets))
        shown = ((block.raw & 0xC0) != 0x80) & ~_SPACES[block.raw]
        words = np.diff(block.first)
        out = {
            "n_words": words,
            "word_chars": np.bincount(row[shown], minlength=n),
            "n_symbols": np.bincount(row[_IS_SYMBOL[block.raw]], minlength=n),
            "n_dup_lines": np.zeros(n, dtype=np.int64),
            "n_repeat_words": _repeat_words(block, n),
        }
        out["base_failed"] = (words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
        out["content_share"] = np.zeros(n)
        for k in range(n):
            lines = _lines(block.raw[block.offsets[k] : block.offsets[k + 1]].tobytes())
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
            labels = viterbi([self.emit[c] for c in line_codes(lines)], self.step)
            size = sum(map(len, lines))
            if size:
                out["content_share"][k] = sum(len(x) for x, y in zip(lines, labels, strict=True) if y) / size
        out["kept"] = ~out["base_failed"] & (out["content_share"] >= MIN_CONTENT_SHARE)
        return out


_KINDS = {"base_failed": "boolean", "kept": "boolean", "content_share": "double"}
_COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share",
)


def judge(docs: DataFrame, model: LineCrf) -> DataFrame:
    """``doc_id``, the counts, the content share and the verdict on every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _Judge(model)
        for batch in blocks(batches):
            found = judged(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[c]) for c in _COLUMNS)], ["doc_id", *_COLUMNS]
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_in_arrow(rows, rate, "doc_id bigint, " + ", ".join(f"{c} {_KINDS.get(c, 'bigint')}" for c in _COLUMNS))


def retain(docs: DataFrame, model: LineCrf) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _Judge(model)
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("text"))], ["text"])
            masks = [judged(b.column("text"))["kept"] for b in blocks(iter([only]))]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return map_in_arrow(docs, keep, docs.schema)


def mark_lines(docs: DataFrame, model: LineCrf) -> DataFrame:
    """``doc_id`` and, line by line, ``content`` (NULL for a line without a word) and the content text."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, step = model.emissions().tolist(), model.step
        for batch in blocks(batches):
            flags, kept = [], []
            for text in batch.column("text").to_pylist():
                lines = text.split("\n")
                real = [x.encode() for x in lines if x.encode().strip()]
                labels = iter(viterbi([emit[c] for c in line_codes(real)], step))
                flags.append([bool(next(labels)) if x.encode().strip() else None for x in lines])
                kept.append("\n".join(x for x, y in zip(lines, flags[-1], strict=True) if y))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(flags, pa.list_(pa.bool_())), pa.array(kept, pa.string())],
                ["doc_id", "content", "content_text"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_in_arrow(rows, mark, "doc_id bigint, content array<boolean>, content_text string")
