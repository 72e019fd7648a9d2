"""Personal data: a semi-Markov CRF over candidate segments, beside fixed base patterns.

Two kinds of text form *clusters* of tokens: numbers with their separators, and
words around something that stands for an at sign (``(at)``, `` at ``, `` @ ``),
joined by dots or what stands for dots. A segment is a run of at most
``MAX_TOKENS`` tokens with a type. Features of the whole segment (number of
digits, grouping, checksum, how the signs are spelled, the ending, the word
before) and of the type of the segment before give its score; dynamic
programming over the cluster chooses boundaries and types together, in time
linear in its tokens (``segment_crf``).

The weights are fitted here by conditional likelihood, with a penalty for
leaving ``DEFAULT``. The examples are the clusters of at most ``max_docs``
documents of each kind, the first by a hash of id and text among all that hold
a base span of the kind, and of ``max_docs`` without any. Segments are the base
spans; added to them are variants that the base patterns miss: a phone number
without its country code, addresses with spelled signs. A kind without an
example keeps its default weights.

Base spans always stay; a decoded span is added where no base span overlaps.
Spans are (kind, start, end) in code points, the end exclusive.

Cases: a NULL or empty text has no spans; rows given twice are searched twice;
texts are searched whole, in time proportional to their length; a document
with a NULL id may give examples as any other, repeated rows give them once;
an empty table gives no rows; without any example ``DEFAULT`` is used; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockroom.llm import segment_crf
from stockroom.llm.segment_crf import MAX_TOKENS, Chosen, Example, Lattice, Segment, Weights
from stockroom.llm.words import blocks
from stockroom.shipping import map_in_arrow
from stockroom.staging import discard, staged

# The kinds, the base patterns and their bounds.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, MAX_PART = (13, 19), (9, 15), 255

#: A phone number without its country code has this many digits at least, and any has this many groups at most.
MIN_PHONE, PHONE_GROUPS = 7, 8

_HAS_DIGIT = re.compile(r"[0-9]")
_CLUSTER = re.compile(r"[+(]{0,2}[0-9]++(?:[\x20().+/-]{1,3}[0-9]++)*+")
_TOKEN = re.compile(r"[0-9]+")
_CUE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}$")
_CUES = {
    "email": ("mail", "email", "contact", "write", "reach"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "cell"),
    "card": ("card", "visa", "mastercard", "credit"),
    "ip": ("ip", "host", "server", "address"),
}

# What stands for the signs of an address; words of one cluster are joined by them.
_AT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20|\x20@\x20?|@\x20", re.IGNORECASE)
_DOT = r"(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|\.)"
_WORD = r"[A-Za-z0-9_%+-]"
#: Words of an address before and after the sign at most, and characters of a word.
ADDRESS_WORDS, WORD_CHARS = 9, 64
_BEFORE = re.compile(
    rf"(?<!{_WORD})(?:{_WORD}{{1,{WORD_CHARS}}}+{_DOT}){{0,{ADDRESS_WORDS - 1}}}{_WORD}{{1,{WORD_CHARS}}}+\Z", re.IGNORECASE
)
_AFTER = re.compile(rf"{_WORD}{{1,{WORD_CHARS}}}+(?:{_DOT}{_WORD}{{1,{WORD_CHARS}}}+){{1,{ADDRESS_WORDS - 1}}}", re.IGNORECASE)
_PART = re.compile(rf"{_WORD}+")
_SPELLED_DOT = re.compile(r"\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20", re.IGNORECASE)
_REACH = 256

Span = tuple[str, int, int]


class Cluster(NamedTuple):
    """Tokens as (start, end), the word before, and for an address how many tokens precede its at sign."""

    tokens: list[tuple[int, int]]
    cue: str
    local: int = 0


#: Where the fitting starts; what a kind without examples keeps.
DEFAULT: Weights = {
    "email bias": -2.0, "email bracketed at": 3.0, "email letters end": 1.0, "email cue": 1.0, "email cut": -4.0,
    "ip bias": -1.0, "ip parts": 3.0,
    "card bias": -2.0, "card luhn": 3.0,
    "phone bias": -3.0, "phone plus": 3.0, "phone area": 3.0, "phone bracket": 1.0,
}


def luhn(digits: str) -> bool:
    """Does the checksum of a card number hold?"""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, kind by kind."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the part before is the longest run of its characters that ends here and is not taken
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _HAS_DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= MAX_PART for p in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 2 * CARD_DIGITS[1]:
            digits = m[0].replace(" ", "").replace("-", "")
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(c.isdigit() for c in m[0]) <= PHONE_DIGITS[1]:
            found.append(("phone", m.start(), m.end()))
    return found


def _features(kind: str, text: str, tokens: list[tuple[int, int]], cue: str) -> list[str]:
    """The features of a run of numbers as a segment of one kind; none if it cannot be one."""
    start, end = tokens[0][0], tokens[-1][1]
    groups = [e - s for s, e in tokens]
    n = sum(groups)
    between = [text[a[1] : b[0]] for a, b in zip(tokens, tokens[1:], strict=False)]
    marks = {"bias"}
    if kind == "ip":
        if len(groups) != 4 or set(between) != {"."}:
            return []
        fits = all(e - s <= 3 and int(text[s:e]) <= MAX_PART for s, e in tokens)
        marks.add("parts" if fits else "too large")
    elif kind == "card":
        if not CARD_DIGITS[0] <= n <= CARD_DIGITS[1] or not set(between) <= {" ", "-"}:
            return []
        marks.add("luhn" if luhn("".join(text[s:e] for s, e in tokens)) else "no checksum")
        marks.add("fours" if set(groups[:-1]) <= {4} and len(groups) > 2 else f"{min(len(groups), 6)} groups")
    else:
        if not MIN_PHONE <= n <= PHONE_DIGITS[1] or len(groups) > PHONE_GROUPS:
            return []
        plus = start > 0 and text[start - 1] == "+"
        marks.add("plus" if plus else "no plus")
        local = groups[1:] if plus else groups
        marks.add("area" if local == [3, 3, 4] else "other grouping")
        marks.add("bracket" if "(" in "".join(between) or (start > 0 and text[start - 1] == "(") else "no bracket")
        if not plus and len(groups) == 1:
            marks.add("plain number")
        if set(between) == {"."}:
            marks.add("dots")
    if any(cue.startswith(c) for c in _CUES[kind]):
        marks.add("cue")
    if end < len(text) and text[end].isalnum():
        marks.add("word after")
    return [f"{kind} {m}" for m in sorted(marks)]


def _number_clusters(text: str) -> Iterator[Cluster]:
    """Every run of digits and separators of at least seven characters."""
    for m in _CLUSTER.finditer(text):
        if m.end() - m.start() >= 7:
            tokens = [t.span() for t in _TOKEN.finditer(text, m.start(), m.end())]
            yield Cluster(tokens, _cue(text, m.start()))


def _address_clusters(text: str) -> Iterator[Cluster]:
    """The words around every sign or word that may stand for an at sign; no word is in two clusters."""
    done = 0
    for m in _AT.finditer(text):
        after = _AFTER.match(text, m.end(), m.end() + _REACH) if m.start() > done else None
        if after is None:
            continue
        begin = max(done, m.start() - _REACH)
        before = _BEFORE.search(text[begin : m.start()])
        if before is None:
            continue
        start, done = begin + before.start(), after.end()
        local = _words(text, start, m.start())
        yield Cluster(local + _words(text, m.end(), done), _cue(text, start), len(local))


def _words(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The words between the dots, spelled or not, of a part of an address."""
    found, at = [], start
    for m in _SPELLED_DOT.finditer(text, start, end):
        found += [w.span() for w in _PART.finditer(text, at, m.start())]
        at = m.end()
    return found + [w.span() for w in _PART.finditer(text, at, end)]


def _cue(text: str, at: int) -> str:
    found = _CUE.search(text[max(0, at - 24) : at])
    return found[1].lower() if found else ""


def clusters(text: str) -> Iterator[Cluster]:
    """All clusters of a text."""
    if _HAS_DIGIT.search(text):
        yield from _number_clusters(text)
    yield from _address_clusters(text)


def _address_features(text: str, cluster: Cluster, i: int, j: int) -> tuple[str, ...]:
    """The features of tokens ``i`` to ``j`` of an address cluster, which hold its at sign."""
    tokens, local = cluster.tokens, cluster.local
    sign = text[tokens[local - 1][1] : tokens[local][0]]
    marks = {"bias", "bracketed at" if sign.strip()[0] in "([{" else "spaced at" if "@" in sign else "word at"}
    if i > 0 or j + 1 < len(tokens):
        marks.add("cut")
    between = [text[a[1] : b[0]] for a, b in zip(tokens[local:j], tokens[local + 1 : j + 1], strict=True)]
    marks.add("plain dots" if set(between) == {"."} else "spelled dots")
    last = text[slice(*tokens[j])]
    marks.add("letters end" if last.isalpha() and 2 <= len(last) <= 6 else "other end")
    if i == 0 and cluster.cue.startswith(_CUES["email"]):
        marks.add("cue")
    return tuple(f"email {m}" for m in sorted(marks))


def ending(text: str, cluster: Cluster, j: int) -> Iterator[Segment]:
    """The candidate segments of a cluster whose last token is ``j``."""
    tokens = cluster.tokens
    if cluster.local:
        if j > cluster.local:
            for i in range(max(0, j + 1 - MAX_TOKENS), cluster.local):
                yield i, j, "email", _address_features(text, cluster, i, j)
        return
    digits = 0
    for i in range(j, max(-1, j - MAX_TOKENS), -1):
        digits += tokens[i][1] - tokens[i][0]
        if digits > CARD_DIGITS[1]:
            return
        groups = j + 1 - i
        possible = (
            ("ip", groups == 4),
            ("card", digits >= CARD_DIGITS[0]),
            ("phone", MIN_PHONE <= digits <= PHONE_DIGITS[1] and groups <= PHONE_GROUPS),
        )
        for kind, may in possible:
            if may:
                features = _features(kind, text, tokens[i : j + 1], cluster.cue if i == 0 else "")
                if features:
                    yield i, j, kind, tuple(features)


def decode(text: str, cluster: Cluster, weights: Weights) -> list[Chosen]:
    """The best segments of a cluster as (kind, first token, last token); ties go to no segment."""
    return segment_crf.decode(len(cluster.tokens), lambda j: ending(text, cluster, j), KINDS, weights)


def lattice(text: str, cluster: Cluster) -> Lattice:
    """All candidate segments of a cluster."""
    n = len(cluster.tokens)
    return n, tuple(s for j in range(n) for s in ending(text, cluster, j))


def _span(text: str, kind: str, tokens: list[tuple[int, int]]) -> Span:
    start, end = tokens[0][0], tokens[-1][1]
    if kind == "phone":
        while start > 0 and text[start - 1] in "+(":
            start -= 1
    return kind, start, end


def added_spans(text: str, base: list[Span], weights: Weights) -> list[Span]:
    """The decoded spans that no base span overlaps."""
    found = [
        _span(text, kind, cluster.tokens[i : j + 1])
        for cluster in clusters(text)
        for kind, i, j in decode(text, cluster, weights)
    ]
    return _apart(found, base)


def _apart(found: list[Span], base: list[Span]) -> list[Span]:
    """The spans that no base span overlaps; both lists are swept in order of their starts."""
    if not found or not base:
        return found
    taken = sorted((s, e) for _, s, e in base)
    reach, furthest = [], 0
    for _, e in taken:  # the furthest end of the base spans so far
        furthest = max(furthest, e)
        reach.append(furthest)
    out, k = [], 0
    for span in sorted(found, key=lambda x: x[1]):
        while k < len(taken) and taken[k][0] < span[2]:
            k += 1
        if k == 0 or reach[k - 1] <= span[1]:
            out.append(span)
    return out


def _chosen(cluster: Cluster, spans: list[Span]) -> tuple[Chosen, ...]:
    """The spans that lie in a cluster as runs of its tokens; of overlapping ones the first."""
    tokens, out = cluster.tokens, []
    for kind, s, e in spans:
        inside = [k for k, t in enumerate(tokens) if t[0] >= s and t[1] <= e]
        if inside and not any(a <= inside[-1] and inside[0] <= b for _, a, b in out):
            out.append((kind, inside[0], inside[-1]))
    return tuple(sorted(out, key=lambda c: c[1]))


def examples(text: str) -> list[Example]:
    """The clusters of a document with their base spans, and variants that the base patterns miss."""
    base = base_spans(text)
    numbers = sorted((s for s in base if s[0] != "email"), key=lambda s: s[1])
    out, at = [], 0
    for cluster in clusters(text):
        start, end = cluster.tokens[0][0] - 2, cluster.tokens[-1][1]
        if len(cluster.tokens) <= 2 * MAX_TOKENS:
            if cluster.local:
                inside = []
            else:
                while at < len(numbers) and numbers[at][2] <= start:
                    at += 1
                inside = [s for s in numbers[at : at + 3 * MAX_TOKENS] if s[1] >= start and s[2] <= end]
            out.append((lattice(text, cluster), _chosen(cluster, sorted(inside, key=lambda s: KINDS.index(s[0])))))
    for kind, s, e in base:
        before, after = text[max(0, s - 26) : s], text[e : e + 2]
        for variant in _variants(kind, text[s:e]):
            excerpt, begin = before + variant + after, len(before)
            for cluster in clusters(excerpt):
                if cluster.tokens[0][0] < begin + len(variant) and cluster.tokens[-1][1] > begin:
                    gold = _chosen(cluster, [(kind, begin, begin + len(variant))])
                    out.append((lattice(excerpt, cluster), gold))
    return [example for example in out if segment_crf.observed(example) is not None]


def _variants(kind: str, span: str) -> list[str]:
    """Other ways of writing a base span."""
    if kind == "phone":
        local = re.fullmatch(r"\+[0-9]{1,3}[\x20.-](.*)", span)
        return [local[1]] if local else []
    if kind != "email" or len(span) > _REACH // 2:
        return []
    spelled = span.replace("@", " at ").replace(".", " dot ")
    return [span.replace("@", " (at) "), span.replace("@", "[at]").replace(".", " [dot] "), spelled, span.replace("@", " @ ")]


def bounded(found: list[Example], most: int) -> list[Example]:
    """At most ``most`` examples of each kind and ``most`` negative ones, the first of each; the positive ones lead."""
    taken: Counter[str] = Counter()
    out = []
    for held, chosen in sorted(found, key=lambda example: not example[1]):
        kinds = {k for k, _, _ in chosen} or {""}
        if any(taken[k] < most for k in kinds):
            taken.update(kinds)
            out.append((held, chosen))
    return out


def train(found: list[tuple[Example, int]]) -> Weights:
    """Weights from examples and their counts; only those of kinds that have an example move."""
    known = {kind for (_, chosen), _ in found for kind, _, _ in chosen}
    outside = {segment_crf.START, segment_crf.OUTSIDE}

    def moves(feature: str) -> bool:
        if ">" not in feature:
            return feature.split(" ")[0] in known
        ends = set(feature.split(">"))
        return ends <= known | outside and not ends <= outside

    return segment_crf.train(found, DEFAULT, moves)


def _packed(example: Example) -> str:
    return json.dumps(example)


def _unpacked(told: str) -> Example:
    (n, segments), chosen = json.loads(told)
    return (n, tuple((i, j, k, tuple(f)) for i, j, k, f in segments)), tuple(tuple(c) for c in chosen)


def fit(docs: DataFrame, max_docs: int = 600, per_doc: int = 20) -> Weights:
    """Weights from at most ``max_docs`` documents of each kind of base span and ``max_docs`` without any.

    A document gives at most ``per_doc`` examples of each kind and ``per_doc``
    without a span. The driver receives each different example once, with its
    count, as features of at most ``2 * MAX_TOKENS`` tokens, not the texts.
    """
    rows = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .where(F.col("text").rlike(r"(?i)[0-9]|@|[(\[{]at[)\]}]|\x20at\x20"))
        .select(F.xxhash64("doc_id", "text").alias("rank"), "text")
    )
    held_schema = pa.schema([("rank", pa.int64()), ("kind", pa.string())])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            out = []
            for rank, text in zip(batch.column("rank").to_pylist(), batch.column("text").to_pylist(), strict=True):
                kinds = {k for k, _, _ in base_spans(text)}
                if not kinds and any(True for _ in clusters(text)):
                    kinds = {""}
                out += [{"rank": rank, "kind": k} for k in sorted(kinds)]
            yield pa.RecordBatch.from_pylist(out, schema=held_schema)

    schema = pa.schema([("example", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            for text in batch.column("text").to_pylist():
                out = [{"example": _packed(example)} for example in bounded(examples(text), per_doc)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = staged(map_in_arrow(rows, held, "rank bigint, kind string").distinct(), "kinds")
    firsts = [kinds.where(F.col("kind") == k).orderBy("rank").limit(max_docs).select("rank") for k in ("", *KINDS)]
    chosen = reduce(DataFrame.unionByName, firsts).distinct()
    texts = rows.join(F.broadcast(chosen), "rank").dropDuplicates(["rank"])
    found = map_in_arrow(texts.select("text"), cut, "example string").groupBy("example").count().collect()
    discard(kinds)
    return train([(_unpacked(r["example"]), r["count"]) for r in found]) if found else DEFAULT


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` by kind, then by start."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def find(docs: DataFrame, weights: Weights) -> DataFrame:
    """Counts of the base spans, their digest, and all spans of every document."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                every = base + added_spans(text, base, weights)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc, *(kinds.count(k) for k in KINDS), digest, listed(every)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_in_arrow(
        rows,
        search,
        f"doc_id bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string",
    )
