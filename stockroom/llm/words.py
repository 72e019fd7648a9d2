"""Words and word hashes of many texts at once, for tasks that run in Python.

A *block* is a run of whole texts of about ``BLOCK_BYTES`` bytes; its bytes are
handled by numpy in one go, so a task holds a few times a block, or a few times
its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: ASCII white space: the separators of ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


#: A value for every byte, and an odd base whose powers mark its place in a word.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX[2])
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse modulo 2^64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = np.uint64(_BASE if kind == "base" else pow(_BASE, -1, 1 << 64))
        size = max(n, 2 * BLOCK_BYTES)
        have = _powers[kind] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]), dtype=np.uint64)
    return have[:n]


class Block(NamedTuple):
    """Some texts: their bytes, and for each word its hash, its text and its place."""

    raw: np.ndarray  # the bytes of all texts
    offsets: np.ndarray  # where each text begins, and the end
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # of each word in raw
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, and the number of words


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with about ``limit`` bytes of text; NULL becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        batch = batch.set_column(at, column, pc.fill_null(batch.column(at).cast(pa.large_string()), ""))
        sizes = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without NULLs, and the offsets of its rows."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_block(texts: pa.LargeStringArray, lower: bool = False) -> Block:
    """Split every text at ASCII white space and hash its words to 64 bits."""
    raw, offsets = bytes_of(texts)
    if lower:
        raw = _LOWER[raw]
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = ~_SPACE[raw]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True  # a text begins: no word goes across
    begins &= inside[:-1]
    starts = np.flatnonzero(begins)
    stops = inside[:-1] & ~inside[1:]
    last = offsets[1:] - 1
    stops[last[last >= 0]] = True
    stops &= inside[:-1]
    ends = np.flatnonzero(stops) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _power("base", len(raw)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power("inverse", len(raw) + 1)[starts])
    first = np.searchsorted(starts, offsets)
    return Block(raw, offsets, hashes, starts, ends, first)


def window_hashes(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``width`` words of one text, and the text that it belongs to."""
    n = len(block.hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h + block.hashes[k : k + n]) * _MIX[2]
    row = np.searchsorted(block.first, np.arange(n), side="right") - 1
    whole = np.arange(n) + width <= block.first[np.minimum(row + 1, len(block.first) - 1)]
    return mix(h[whole]), row[whole]
