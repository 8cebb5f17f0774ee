"""Operator 1: byte-level BPE encoding and decoding.

The rank file becomes a sentencepiece BPE model without any training: the model's protobuf is written here
directly. Each vocabulary entry is spelled with one stand-in character per byte and gets the score ``-rank``,
so that sentencepiece's "merge the best-scoring neighbour first, leftmost on ties" is the rank order; the
normaliser is the identity, without dummy prefix, space removal or space escape. Texts are cut by the
pre-token pattern and each pre-token is encoded on its own; decoding maps ids back to bytes.

Null text counts as empty: no ids. Equal texts give equal rows; repeated ids stay separate rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_arrow

#: Stand-in characters for bytes 0-255: a block of letters without combining or white-space characters.
FIRST_CHAR = 0x4E00
#: Pre-tokens of up to so many characters are remembered by a Python worker; the store is emptied when full.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Pre-tokens of one text that are in hand at once.
RUN = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 of the bytes, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def spell(token: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in token)


_STAND_IN = {b: chr(FIRST_CHAR + b) for b in range(256)}


def serialised(pieces: list[tuple[str, float]]) -> bytes:
    """A sentencepiece BPE model of these pieces and scores, and an unknown piece after them.

    Field numbers are those of the public sentencepiece_model.proto.
    """
    score = lambda x: _varint(2 << 3 | 5) + struct.pack("<f", x)
    body = [_field(1, _field(1, piece.encode()) + score(s)) for piece, s in pieces]
    unknown = _field(1, _field(1, b"<unk>") + score(0.0) + _field(3, 2))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = (
        _field(3, 2)
        + _field(4, len(pieces) + 1)
        + _field(40, len(pieces))
        + _field(41, none)
        + _field(42, none)
        + _field(43, none)
    )
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(body) + unknown + _field(2, trainer) + _field(3, normalizer)


def sentencepiece_model(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """Serialised model, and the rank of each of its piece ids."""
    order = sorted(ranks, key=ranks.__getitem__)
    return serialised([(spell(t), -float(ranks[t])) for t in order]), np.array([ranks[t] for t in order] + [-1], dtype=np.int64)


class Codec:
    """Encoder and decoder of one vocabulary; lives in a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import sentencepiece

        model, self.ids = sentencepiece_model(ranks)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.cache: dict[str, bytes] = {}

    def _pre_token(self, token: str) -> bytes:
        raw = token.encode("utf-8", "surrogatepass").decode("latin-1").translate(_STAND_IN)
        ids = self.ids[self.processor.encode(raw)].astype("<u4").tobytes()
        if len(token) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[token] = ids
        return ids

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids as little-endian unsigned 32-bit integers."""
        known, make = self.cache.get, self._pre_token
        found = self.pattern.findall(text) if len(text) < 4 * RUN else None
        if found is not None:
            yield b"".join([known(t) or make(t) for t in found])
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, RUN)):
            yield b"".join([known(t) or make(t) for t in run])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def _vocabulary(spark: SparkSession, path: str) -> tuple[Broadcast, str]:
    """The ranks, which are a few hundred kB whatever the corpus, and a name for their content."""
    ranks = load_ranks(path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast(ranks), name


def _codec(shared: Broadcast, name: str, pattern: str) -> Codec:
    """Built once in each Python worker."""
    if (name, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[name, pattern] = Codec(shared.value, pattern)
    return _CODECS[name, pattern]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian u32) per row."""
    return _run(df, ranks_path, pattern, id_col, text_col, ids=True)


def digest(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids again and returns (doc_id, n_tokens, ids_sha256, decoded_sha256) per row."""
    return _run(df, ranks_path, pattern, id_col, text_col, ids=False)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, bytes) from what encode() returned; null ids give empty bytes."""
    shared, name = _vocabulary(df.sparkSession, ranks_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, name, "")
        for b in batches:
            out = [codec.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run, f"doc_id {kind}, bytes binary")


def _run(df: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, ids: bool) -> DataFrame:
    shared, name = _vocabulary(df.sparkSession, ranks_path)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("ids binary" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, name, pattern)
        for b in batches:
            if ids:
                out = [b"".join(codec.encode(t.as_py() or "")) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])
                continue
            counts, shas, back = [], [], []
            for t in b.column(1):
                n, sha, raw = 0, hashlib.sha256(), hashlib.sha256()
                for part in codec.encode(t.as_py() or ""):
                    n += len(part) // 4
                    sha.update(part)
                    raw.update(codec.decode(part))
                counts.append(n)
                shas.append(sha.hexdigest())
                back.append(raw.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
