"""Vectorised text scanning over Arrow string columns.

A *block* is the UTF-8 bytes of some whole texts laid end to end plus their offsets. All helpers work on
blocks of about 256 kB (one longer text makes a block of its own), so memory stays flat whatever the
Arrow batch holds. Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; lines are split at ``\\n``.

Hashes are 64-bit: a span's value is a polynomial over random byte codes with an odd base modulo 2**64, taken
from one prefix sum (the base has an inverse, so any span is two lookups and a product), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
CODES = {False: _CODES, True: _CODES[_FOLD]}
_WINDOW = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | _U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand to the longest block seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.full(size, _BASE, dtype=np.uint64)) * _U64(_BASE_INV)
            self.down = np.cumprod(np.full(size, _BASE_INV, dtype=np.uint64)) * _U64(_BASE)
        return self.up, self.down


_POWERS = _Powers()


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range; equal content and length give equal hashes anywhere."""
    n = len(values)
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


@dataclass
class Block:
    first: int  # row of the first text within the Arrow array
    data: np.ndarray  # uint8
    off: np.ndarray  # int64, one more than texts

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text index of every word."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        gap = SPACE[self.data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.off] = True
        opens = edge[:-1].copy()
        opens[1:] |= gap[:-1]
        closes = edge[1:].copy()
        closes[:-1] |= gap[1:]
        starts = np.flatnonzero(opens & ~gap)
        ends = np.flatnonzero(closes & ~gap) + 1
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1

    def line_spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all lines, also empty ones, in order."""
        cut = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.off[:-1], cut + 1]), kind="stable")
        ends = np.sort(np.concatenate([cut, self.off[1:]]), kind="stable")
        return starts, ends

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """fold: A-Z count as a-z."""
        return range_hash(CODES[fold][self.data], starts, ends)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks over a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    rows = len(column)
    if not rows:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < rows:
        stop = int(np.searchsorted(off, off[at] + most, "right")) - 1
        stop = min(rows, max(stop, at + 1))
        yield Block(at, data[off[at] : off[stop]], off[at : stop + 1] - off[at])
        at = stop


def windows(words: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the index of each run's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        h += words[first + k] * _WINDOW[k]
    return mix(h), first


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or integer sum of weights, by text."""
    return np.bincount(owner, weights, minlength=n).astype(np.int64)
