"""Message envelopes in the protocol buffer wire format: field 1 source (enumeration), 2 time in microseconds, 3 the message's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the enumeration's values, in order; fixed values.
SOURCES = ["ogn", "beast", "sbs"]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 0x80:
            return value & (1 << 64) - 1, at


def fields(raw: bytes) -> dict[int, int | bytes]:
    """Field numbers and values; the last of a repeated field counts. ValueError or IndexError if it is no message."""
    out: dict[int, int | bytes] = {}
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            out[tag >> 3], at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            if at + size > len(raw):
                raise ValueError("cut short")
            out[tag >> 3], at = raw[at : at + size], at + size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError("no such wire type")
    return out


def decoded(df: DataFrame, value: str = "value") -> DataFrame:
    """(source, received_at, data) of binary envelopes; those that cannot be read or have an unknown source are dropped. Absent fields are zero or empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf["value"]:
                try:
                    f = fields(bytes(raw))
                    source, micros = f.get(1, 0), f.get(2, 0)
                    rows.append((SOURCES[source], micros - (micros >> 63 << 64), f.get(3, b"")))
                except (ValueError, IndexError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["source", "micros", "data"])

    read = df.select(F.col(value).alias("value")).filter("value IS NOT NULL").mapInPandas(run, "source string, micros long, data binary")
    return read.select("source", F.timestamp_micros("micros").alias("received_at"), "data")


def routed(df: DataFrame) -> dict[str, DataFrame]:
    """The decoded envelopes of each source; also over a stream."""
    return {s: df.filter(F.col("source") == s) for s in SOURCES}
