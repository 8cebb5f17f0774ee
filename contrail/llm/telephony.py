"""Operator 4: media columns for telephony audio.

``store`` wraps a payload losslessly as 8 kHz telephony media: a RIFF/WAVE byte string whose samples are the
payload's bytes as mu-law or A-law codes, or whose 64-byte blocks are IMA ADPCM blocks. ``decode`` parses the
stored bytes again, expands mu-law and A-law through 256-entry lookup tables, decodes ADPCM blocks with numpy
across all blocks of a batch at once (one step per nibble position), and resamples to 16 kHz signed 16-bit PCM
with a four-tap half-band interpolator in integers, so results are the same on every machine.

Null or empty payload text gives a payload of 64 zero bytes. Equal texts give equal bytes: the codec is chosen
from the payload alone. Rows are independent; repeated rows stay.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow

RATE = 8000
BLOCK = 64
#: WAVE format tags.
MULAW, ALAW, ADPCM = 7, 6, 0x11
CODECS = {0: MULAW, 1: ALAW, 2: ADPCM}
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}
#: Payload bytes decoded at once.
AT_ONCE = 1 << 20


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}
#: IMA ADPCM: fixed values of the published format.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
     118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
     1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
     6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
     32767]
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the signed change of the prediction, and the next step index."""
    nibble = np.arange(16)
    step = STEPS[:, None]
    size = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    change = np.where(nibble & 8, -size, size)
    return change.astype(np.int32), np.clip(np.arange(89)[:, None] + INDEX_MOVES, 0, 88).astype(np.int32)


_CHANGE, _NEXT = (t.ravel() for t in _moves())


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, size) of bytes to samples (n, 2 * (size - 4) + 1); any bytes are valid."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * (size - 4)):
        nibble = (columns[k >> 1] >> 4 if k & 1 else columns[k >> 1] & 15).astype(np.int32)
        at = index * 16 + nibble
        value = np.clip(value + _CHANGE[at], -32768, 32767)
        index = _NEXT[at]
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Twice the rate for signals laid end to end; off has their bounds. Edges repeat the end samples."""
    lengths = np.diff(off)
    low, high = np.repeat(off[:-1], lengths), np.repeat(off[1:] - 1, lengths)
    here = np.arange(len(pcm))
    x = pcm.astype(np.int32)
    before, after, next_but_one = x[np.maximum(here - 1, low)], x[np.minimum(here + 1, high)], x[np.minimum(here + 2, high)]
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x + after) - before - next_but_one + 8) >> 4, -32768, 32767)
    return out


def wave(payload: bytes, tag: int) -> bytes:
    """A mono 8 kHz WAVE file around the payload."""
    if tag == ADPCM:
        per_block = 2 * (BLOCK - 4) + 1
        samples = len(payload) // BLOCK * per_block
        fmt = struct.pack("<HHIIHHHH", tag, 1, RATE, RATE * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        samples = len(payload)
        fmt = struct.pack("<HHIIHHH", tag, 1, RATE, RATE, 1, 8, 0)
    body = b"".join(
        name + struct.pack("<I", len(data)) + data
        for name, data in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload))
    )
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def unwave(media: bytes) -> tuple[int, bytes]:
    """Format tag and samples of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            return tag, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def store(df: DataFrame, payload: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media) per row; payload is a binary column, padded here to a positive multiple of 64."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, 1):
                media, sizes = [], []
                for x in rows.column(1):
                    raw = x.as_py() or b""
                    padded = raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))
                    media.append(wave(padded, CODECS[zlib.crc32(padded) % 3]))
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(F.col(id_col).alias("doc_id"), payload.cast("binary").alias("p")), run, f"doc_id {kind}, n_bytes long, media binary")


def decode(df: DataFrame) -> DataFrame:
    """df of store(), with ``payload`` as read back, ``codec``, 16 kHz ``pcm`` (signed 16-bit little-endian), ``peak`` and ``mean_abs``."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, 2):
                parsed = [unwave(x.as_py()) for x in rows.column(2)]
                pcm = _decoded(parsed)
                wide = [np.abs(x.astype(np.int32)) for x in pcm]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([p for _, p in parsed], pa.binary()),
                        pa.array([NAMES[t] for t, _ in parsed]),
                        pa.array([x.astype("<i2").tobytes() for x in pcm], pa.binary()),
                        pa.array([int(x.max(initial=0)) for x in wide], pa.int64()),
                        pa.array([int(x.sum()) // max(1, len(x)) for x in wide], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "media", "payload", "codec", "pcm", "peak", "mean_abs"],
                )

    return in_arrow(
        df,
        run,
        f"doc_id {kind}, n_bytes long, media binary, payload binary, codec string, pcm binary, peak long, mean_abs long",
    )


def _decoded(parsed: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """16 kHz samples of each (tag, payload)."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(parsed)
    for tag in NAMES:
        own = [i for i, (t, _) in enumerate(parsed) if t == tag]
        if not own:
            continue
        raw = np.frombuffer(b"".join(parsed[i][1] for i in own), dtype=np.uint8)
        lengths = np.array([len(parsed[i][1]) for i in own])
        if tag == ADPCM:
            pcm = adpcm(raw.reshape(-1, BLOCK))
            lengths = lengths // BLOCK * pcm.shape[1]
            pcm = pcm.ravel()
        else:
            pcm = TABLES[tag][raw]
        off = np.concatenate([[0], np.cumsum(lengths)])
        wide = resampled(pcm, off)
        for k, i in enumerate(own):
            out[i] = wide[2 * off[k] : 2 * off[k + 1]]
    return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about AT_ONCE bytes in a column."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= AT_ONCE:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The digest of each text's stored and read-back media."""
    heard = decode(store(df, F.col(text_col).cast("binary"), id_col))
    return heard.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ":", "codec", (F.octet_length("pcm") / 2).cast("long").cast("string"), F.crc32("pcm").cast("string"), F.col("peak").cast("string"), F.col("mean_abs").cast("string")
        ).alias("feature"),
    )
