"""Token ids as directly addressable codes.

Ids are split into chunks of ``WIDTHS`` bits. The first level has the lowest
chunk of every token; a bitmap says which tokens go on, and the next level has
only those. A rank directory counts the set bits before every ``RANK_BITS``
bits, so any token is reached with one rank per level, without decoding what
lies around it.

A file set is a Parquet folder that Spark writes and commits: one file per
range of ``doc_id``, one row per segment of whole documents (about
``SEGMENT_TOKENS`` tokens, or one longer document). The levels, bitmaps and
directories of a segment are binary columns, little-endian:

    range_no, segment_no   place of the segment; ranges ascend with doc_id
    first_token            tokens of the range before the segment
    n_tokens, doc_ids, doc_starts (in the segment)
    chunks_0, more_0, ranks_0, chunks_1, more_1, ranks_1, chunks_2

Cases: a NULL or empty text has only the end token; NULL ids come first; rows
given twice are written twice, side by side; rows of one id are ordered by text
and divided among ranges where their texts begin differently; an empty table gives an empty
folder; extra columns are not written.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockroom.llm.words import blocks
from stockroom.shipping import map_in_arrow

VOCABULARY = "word_bpe_49k.json"
END = 1
WIDTHS = (8, 8, 16)
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
RANGE_BYTES = 32 << 20
OPENING_CHARS = 64

#: Ranges whose first positions are broadcast: 16 bytes each; beyond them the join is Spark's to choose.
BROADCAST_RANGES = 1 << 20

_DTYPES = ("u1", "u1", "<u2")


def encode_codes(ids: np.ndarray) -> dict[str, bytes]:
    """The levels, bitmaps and rank directories of some ids below 2^32."""
    out, rest = {}, ids.astype(np.uint32)
    for k, (width, kind) in enumerate(zip(WIDTHS, _DTYPES, strict=True)):
        out[f"chunks_{k}"] = (rest & np.uint32((1 << width) - 1)).astype(kind).tobytes()
        if k + 1 < len(WIDTHS):
            rest = rest >> np.uint32(width)
            more = rest > 0
            out[f"more_{k}"] = np.packbits(more, bitorder="little").tobytes()
            counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)) if len(more) else np.empty(0, int)
            out[f"ranks_{k}"] = (np.cumsum(counts) - counts).astype("<u4").tobytes()
            rest = rest[more]
    return out


def decode_codes(codes: Mapping[str, bytes], n: int) -> np.ndarray:
    """All ids of a segment."""
    out = np.zeros(n, dtype=np.uint32)
    at, shift = np.arange(n), 0
    for k, (width, kind) in enumerate(zip(WIDTHS, _DTYPES, strict=True)):
        out[at] |= np.frombuffer(codes[f"chunks_{k}"], dtype=kind).astype(np.uint32) << np.uint32(shift)
        shift += width
        if k + 1 < len(WIDTHS):
            bits = np.unpackbits(np.frombuffer(codes[f"more_{k}"], np.uint8), count=len(at), bitorder="little")
            at = at[bits.astype(bool)]
    return out


def token_at(codes: Mapping[str, bytes], i: int) -> int:
    """One id of a segment, by one rank per level."""
    value, shift = 0, 0
    for k, (width, kind) in enumerate(zip(WIDTHS, _DTYPES, strict=True)):
        size = np.dtype(kind).itemsize
        value |= int.from_bytes(codes[f"chunks_{k}"][i * size : (i + 1) * size], "little") << shift
        shift += width
        if k + 1 == len(WIDTHS) or not codes[f"more_{k}"][i >> 3] >> (i & 7) & 1:
            return value
        block, inside = divmod(i, RANK_BITS)
        before = int.from_bytes(codes[f"ranks_{k}"][4 * block : 4 * block + 4], "little")
        begin = block * RANK_BITS // 8
        bits = int.from_bytes(codes[f"more_{k}"][begin : begin + RANK_BITS // 8], "little")
        i = before + (bits & ((1 << inside) - 1)).bit_count()
    return value


#: Texts of small letters of Latin-1, digits, ASCII signs but the apostrophe, and ASCII white space: the
#: tokenizer's normalizer leaves them as they are, and its model gets exactly these runs. In Latin-1.
_LETTERS = rb"a-z\xdf-\xf6\xf8-\xff"
_SIGNS = rb"!-&(-/:-@\[-`{-~"
_RUN = re.compile(rb"[" + _LETTERS + rb"]+|[0-9]|[" + _SIGNS + rb"]+")
_PLAIN = bytes(b for b in range(256) if re.match(rb"[" + _LETTERS + _SIGNS + rb"0-9\x09-\x0d\x20]", bytes([b])))


def _byte_letters() -> dict[int, int]:
    """The character that byte-level vocabularies use for each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}


def _plain(text: str) -> bytes | None:
    """A text in lower case and Latin-1 if it is plain."""
    if "<|" in text:
        return None
    try:
        raw = text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _PLAIN) else raw


class _Memory(dict):
    """Ids by word; a word that is not known yet is encoded and kept."""

    def __init__(self, encode: Callable[[bytes], bytes], older: dict[bytes, bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordEncoder:
    """A tokenizer whose tokens never cross white space, with a memory of what it has seen.

    A plain text is cut into runs of letters, digits or signs, and the model is
    asked once for each different run. Any other text is cut at ASCII white
    space, and each different word is encoded once. A memory has two
    generations of about ``GENERATION`` entries: when the younger is full it
    becomes the older, so what is in use stays.
    """

    GENERATION = 350_000
    _CHARACTERS = _byte_letters()

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letter = "H" if self.kind.itemsize == 2 else "I"
        self.words = _Memory(self._word, {})
        self.runs = _Memory(self._run, {})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        out = []
        for text in texts:
            plain = _plain(text)
            if plain is not None:
                ids = b"".join(map(self.runs.__getitem__, _RUN.findall(plain)))
            elif "<|" in text:  # a special token may cross what looks like a word
                ids = self._whole(text)
            else:
                ids = b"".join(map(self.words.__getitem__, text.encode().split()))
            out.append(np.frombuffer(ids, dtype=self.kind))
            self.words = self._kept(self.words)
            self.runs = self._kept(self.runs)
        return out

    def _kept(self, memory: _Memory) -> _Memory:
        return _Memory(memory.encode, dict(memory)) if len(memory) > self.GENERATION else memory

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _plain(text)
        if plain is None:
            return self._whole(text)
        return b"".join([self.runs[r] for r in _RUN.findall(plain)])

    def _run(self, run: bytes) -> bytes:
        """The ids of a run that the tokenizer would hand to its model as it is."""
        mapped = run.decode("latin-1").encode().decode("latin-1").translate(self._CHARACTERS)
        return self._packed([t.id for t in self.model.tokenize(mapped)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """The encoder of a vocabulary; a worker keeps it from task to task."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


#: The last level needs no bitmap.
_BINARY = [f"{part}_{k}" for k in range(len(WIDTHS)) for part in ("chunks", "more", "ranks")][:-2]
_SEGMENT = pa.schema(
    [
        ("range_no", pa.int32()), ("segment_no", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), *((c, pa.binary()) for c in _BINARY),
    ]
)
SCHEMA = (
    "range_no int, segment_no int, first_token bigint, n_tokens bigint, doc_ids array<bigint>, "
    "doc_starts array<bigint>, " + ", ".join(f"{c} binary" for c in _BINARY)
)


def _segment(range_no: int, segment_no: int, first: int, doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(p) for p in parts])
    ids = np.concatenate(parts)
    row = {
        "range_no": range_no, "segment_no": segment_no, "first_token": first, "n_tokens": len(ids),
        "doc_ids": doc_ids, "doc_starts": (np.cumsum(sizes) - sizes).tolist(), **encode_codes(ids),
    }
    return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending ``doc_id`` order."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).collect()[0][0] or 0
    opening = F.substring("text", 1, OPENING_CHARS)  # rows of one id are divided by how their texts begin
    ranges = rows.repartitionByRange(size // RANGE_BYTES + 1, "doc_id", opening).sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, segment_no, waiting = encoder(vocabulary), 0, 0, 0
        doc_ids: list = []
        parts: list[np.ndarray] = []
        range_no = 0
        for batch in blocks(batches):
            range_no = batch.column("range_no")[0].as_py()
            encoded = known.encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                doc_ids.append(doc)
                parts.append(np.append(ids, known.kind.type(end)))
                waiting += len(ids) + 1
                if waiting >= SEGMENT_TOKENS:
                    yield _segment(range_no, segment_no, first, doc_ids, parts)
                    first, segment_no, waiting, doc_ids, parts = first + waiting, segment_no + 1, 0, [], []
        if parts:
            yield _segment(range_no, segment_no, first, doc_ids, parts)

    numbered = ranges.select("doc_id", "text", F.spark_partition_id().alias("range_no"))
    map_in_arrow(numbered, encode, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments, with ``start``: all tokens before the segment.

    Only one sum per range meets in one place; its rows are counted before they are broadcast.
    """
    segments = spark.read.schema(SCHEMA).parquet(path)
    sizes = segments.groupBy("range_no").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_no", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("range_start"))
    if sizes.count() <= BROADCAST_RANGES:
        starts = F.broadcast(starts)
    return segments.join(starts, "range_no").withColumn("start", F.col("range_start") + F.col("first_token"))


def documents(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, decoded from its segment."""
    return _decoded(segments, ids=True)


def digests(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from its segment."""
    return _decoded(segments, ids=False)


def _decoded(segments: DataFrame, ids: bool) -> DataFrame:
    last = ("ids", pa.list_(pa.int64())) if ids else ("ids_crc32", pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("start", "n_tokens", "doc_ids", "doc_starts", *_BINARY)}
                values = decode_codes(row, row["n_tokens"]).astype("<u4")
                bounds = [*row["doc_starts"], row["n_tokens"]]
                pieces = [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["start"] + s for s in row["doc_starts"]], pa.int64()),
                        pa.array([len(p) for p in pieces], pa.int64()),
                        pa.array(pieces if ids else [zlib.crc32(p.tobytes()) for p in pieces], last[1]),
                    ],
                    schema=schema,
                )

    kind = "ids array<bigint>" if ids else "ids_crc32 bigint"
    columns = segments.select("start", "n_tokens", "doc_ids", "doc_starts", *_BINARY)
    return map_in_arrow(columns, decode, f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """``position, token`` for the asked positions (a column ``position``), without decoding segments.

    Positions find their segment by its bounds alone, on slices of
    ``SEGMENT_TOKENS`` positions, and are gathered per segment, each once with
    its count, before they meet the levels; so a segment's levels move at most
    once. A position that is NULL or outside gives no row.
    """
    piece = lambda c: F.floor(c / SEGMENT_TOKENS)
    place = ["range_no", "segment_no"]
    asked = positions.select(F.col("position").cast("bigint")).groupBy("position").agg(F.count("*").alias("times"))
    bounds = segments.select(
        *place, "start", "n_tokens",
        F.explode(F.sequence(piece(F.col("start")), piece(F.col("start") + F.col("n_tokens") - 1))).alias("slice"),
    )
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    gathered = (
        asked.withColumn("slice", piece(F.col("position")))
        .join(bounds, "slice")
        .where(inside)
        .groupBy(*place)
        .agg(F.collect_list("position").alias("positions"), F.collect_list("times").alias("times"))
    )
    grouped = segments.select(*place, "start", *_BINARY).join(gathered, place).drop(*place)
    schema = pa.schema([("position", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tokens = [token_at(row, p - row["start"]) for p in row["positions"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64()) for v in (row["positions"], tokens, row["times"])], schema=schema
                )

    picked = map_in_arrow(grouped, pick, "position bigint, token bigint, times bigint")
    repeated = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    return picked.select("position", "token", repeated.alias("_time")).drop("_time")
