"""Operator 13: near-duplicates by 64-bit SimHash and covering locality-sensitive hashing.

Fingerprints: A-Z count as a-z; words are runs outside ``\\x20\\x09-\\x0D``; every 3-word shingle, repeats included, is hashed by XXH64 (seed 42) of its
words joined by a space; a bit is 1 if it is set in over half the hashes. A text of fewer words is one shingle; without words, and for null, the
fingerprint is zero, which links like any other.

Links of at most ``radius`` bits: each bit gets a non-zero vector of ``radius + 1`` bits; for each non-zero vector v a mask keeps the bits whose
vector has an odd product with v. The vectors of the bits in which a pair differs span less than the whole space, so some v is orthogonal to all of them
and that mask keeps none of those bits: the pair has equal masked values there, whatever the data. A mask keeps about half the bits. Only distinct fingerprints take part, so exact
copies are one row. A bucket above ``BUCKET`` fingerprints is masked again by the same construction over its free bits, which no pair
within the radius can escape either, until it is small or so few bits are free that its distinct values are few. Within a bucket a search from each fingerprint through those not
reached yet leaves one link for each that it reaches: a spanning forest, not all pairs.

Every row counts as a document; repeated rows and ids, and rows without an id, keep their rows. ``component_id`` is the smallest id reachable; null only where no
row of the component has an id. An empty table gives no rows. Long texts are hashed in runs of shingles. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import in_arrow, stored

BITS = 64
RADIUS = 3
WORDS, SEED = 3, 42
#: Fingerprints of a bucket above which it is masked again, and free bits up to which it never is: 2 ** FEW_BITS values at most.
BUCKET, FEW_BITS = 1 << 14, 16
#: Shingles of a text that are hashed at once.
RUN = 100_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of a text, unsigned."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: only A-Z fold, only \\x20\\x09-\\x0D cut
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1 :] if len(parts) >= words else ends[-1:]).tolist()
    total, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + RUN], last[at : at + RUN], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint long) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fingerprint"])

    return in_arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fingerprint long")


def covering_masks(radius: int, free: int = (1 << BITS) - 1) -> list[int]:
    """Masks over the set bits of ``free``: any two values that differ in at most ``radius`` of those bits are equal under one of them."""
    count = (1 << radius + 1) - 1
    places = [b for b in range(BITS) if free >> b & 1]
    vector = {b: 1 + k % count for k, b in enumerate(places)}
    return [sum(1 << b for b in places if (vector[b] & v).bit_count() & 1) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def buckets(distinct: DataFrame, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """(mask, key, fingerprint) rows of all buckets, a mask being its own number; those above the limit are replaced by the buckets of further masks."""
    most = most or BUCKET

    def under(rows: DataFrame, masks: list[int]) -> DataFrame:
        spread = rows.select(F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"), "fingerprint")
        return spread.withColumn("key", F.col("mask").bitwiseAND(F.col("fingerprint")))

    done, rows, level = [], under(distinct, covering_masks(radius)), 0
    while True:
        sizes = rows.groupBy("mask", "key").count()
        few = F.bit_count(F.bitwise_not("mask")) <= FEW_BITS
        large = stored(sizes.filter((F.col("count") > most) & ~few).select("mask", "key"), f"large{level}")
        masks = sorted(r.mask for r in large.select("mask").distinct().collect())  # masks, not buckets: their number is fixed by the radius
        if not masks:
            return rows if not done else _united([*done, rows])
        done.append(rows.join(large, ["mask", "key"], "left_anti"))
        again = rows.join(large, ["mask", "key"], "left_semi")
        finer = {m: [m | f for f in map(_signed, covering_masks(radius, ~m & (1 << BITS) - 1))] for m in masks}
        table = F.create_map(*(x for m, fs in finer.items() for x in (F.lit(m), F.array(*map(F.lit, fs)))))
        spread = again.select(F.explode(table[F.col("mask")]).alias("mask"), "fingerprint").distinct()
        rows, level = stored(spread.withColumn("key", F.col("mask").bitwiseAND(F.col("fingerprint"))), f"finer{level}"), level + 1


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def spanning(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join whatever distinct values are reachable from one another: each value is reached at most once."""
    links, rest = [], values
    while len(rest) > 1:
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            at = ahead.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                reached = rest[near]
                links += [(int(at), int(x)) for x in reached]
                ahead += list(reached)
                rest = rest[~near]
    return links


def links(distinct: DataFrame, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """(a, b): links of at most ``radius`` bits between distinct fingerprints, enough to join all that are reachable from one another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def close() -> list[tuple[int, int]]:
            values = np.concatenate(held).view(np.uint64) if held else np.zeros(0, np.uint64)
            return spanning(values, radius) if len(values) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, value = (batch.column(c).to_numpy() for c in ("mask", "key", "fingerprint"))
            change = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.append(change, len(value))
            found = []
            if (mask[0], key[0]) != open_key:
                found += close()
                held = []
            if len(starts) == 1:
                open_key = mask[0], key[0]
                held.append(value)
            else:
                held.append(value[: ends[0]])
                found += close()
                inner = np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1
                for k in inner.tolist():
                    found += spanning(value[starts[k] : ends[k]].view(np.uint64), radius)
                open_key, held = (mask[-1], key[-1]), [value[starts[-1] :]]
            yield _rows(found)
        yield _rows(close())

    def _rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

    dealt = buckets(distinct, radius, most).repartition("mask", "key").sortWithinPartitions("mask", "key")
    return in_arrow(dealt, run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; fingerprint as 16 hexadecimal digits."""
    rows = stored(fingerprints(df, id_col, text_col, words), "fingerprints")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes.select("fingerprint"), radius))
    named = classes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = named.join(least, "comp").select("fingerprint", "component_id")
    # a fingerprint without links is its own component
    all_of = classes.join(of, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fingerprint"), BITS // 4, "0"))
    return rows.join(all_of, "fingerprint").select("doc_id", shown.alias("fingerprint"), "component_id")
