"""Secrets: fixed shapes, and random strings that a tokenizer's vocabulary cannot compress.

A byte-pair vocabulary covers words and names with few tokens. A long run of
letters and digits that needs a token for less than ``MAX_RATIO`` characters
was hardly written by a person; names and words need fewer. Runs that are known
to be harmless are left out whatever their ratio: digests by their length,
UUIDs, dates and numbers.

Spans are (kind, start, end) in code points, the end exclusive. The base kinds
are matched leftmost and without overlap per kind. ``random`` spans never overlap
them: where a base span covers a part of a run, the parts that remain are
tested, without the signs at their ends.

Cases: a NULL or empty text has no spans; rows given twice are scanned twice;
texts are scanned whole, in time proportional to their length; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm.words import blocks
from stockroom.shipping import map_in_arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RATIO = 1.75

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

_KEYWORDS = ("passw", "secret", "token", "api")
#: Characters of a run that is tested, at least.
MIN_RUN = 16
#: Every access, hex and random span lies inside such a run.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Digests of these lengths (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) are identifiers.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_ANY_HEX = re.compile(r"[0-9A-Fa-f]+")
_SIGNS = "+/_=-"
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Numbers and dates, and lines of separators.
_NUMBER = re.compile(r"(?:[0-9]++(?:T[0-9]++)?+Z?+|[+/_=-]++)++")

Span = tuple[int, str, int]  # start, kind, end
_vocabularies: dict[str, tiktoken.Encoding] = {}


def vocabulary(name: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks, read once per worker."""
    if name not in _vocabularies:
        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _vocabularies[name] = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _vocabularies[name]


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed shapes."""
    found = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for run in _RUN.finditer(text):
        # no base span of these two kinds crosses the end of a run, so matching inside it finds the same
        for m in _ACCESS.finditer(text, run.start(), run.end()):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), "access", m.end()))
        for m in _HEX.finditer(text, run.start(), run.end()):
            if m.end() - m.start() >= MIN_HEX:
                found.append((m.start(), "hex", m.end()))
    return found


def harmless(run: str, encoding: tiktoken.Encoding | None = None, max_ratio: float = MAX_RATIO) -> bool:
    """Is the run a digest, an identifier, a number, or like words by its characters per token?"""
    if _UUID.fullmatch(run) or (len(run) in _DIGEST_LENGTHS and _ANY_HEX.fullmatch(run)) or _NUMBER.fullmatch(run):
        return True
    return len(run) >= max_ratio * _tokens(run, encoding or vocabulary(VOCABULARY))


def _uncovered(runs: Iterator[re.Match], base: list[Span]) -> Iterator[tuple[int, int, bool]]:
    """The parts of runs outside the base spans, in order, and whether a part is a whole run."""
    covers = sorted((start, end) for start, _, end in base)
    k, reach = 0, 0  # covers before k begin before the run; ``reach`` is the farthest end among them
    for m in runs:
        at, end = m.span()
        while k < len(covers) and covers[k][0] < at:
            reach, k = max(reach, covers[k][1]), k + 1
        at = max(at, reach)
        while k < len(covers) and covers[k][0] < end:
            if covers[k][0] > at:
                yield at, covers[k][0], False
            reach, k = max(reach, covers[k][1]), k + 1
            at = max(at, reach)
        if at < end:
            yield at, end, at == m.start()


def random_spans(text: str, base: list[Span], encoding: tiktoken.Encoding, max_ratio: float) -> list[Span]:
    """Runs, or what base spans leave of them, with few characters per token."""
    found = []
    for start, end, whole in _uncovered(_RUN.finditer(text), base):
        part = text[start:end]
        if not whole:
            start += len(part) - len(part.lstrip(_SIGNS))
            part = part.strip(_SIGNS)
        if len(part) >= MIN_RUN and not harmless(part, encoding, max_ratio):
            found.append((start, "random", start + len(part)))
    return found


def _tokens(run: str, encoding: tiktoken.Encoding, piece: int = 4096) -> int:
    """The tokens of a run; pieces bound the time, which grows faster than the length of a single one."""
    return sum(len(encoding.encode_ordinary(run[k : k + piece])) for k in range(0, len(run), piece))


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by start, then by kind."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in ordered)


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
    ]
)


def scan(docs: DataFrame, vocabulary_name: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Counts per kind, a digest of the base spans and all spans of every document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocabulary_name)
        for batch in blocks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                every = base + random_spans(text, base, encoding, max_ratio)
                kinds = [kind for _, kind, _ in every]
                rows.append(
                    (doc, *(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))
                )
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_in_arrow(
        rows,
        search,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string",
    )
