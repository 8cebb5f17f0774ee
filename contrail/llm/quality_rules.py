"""Operator 3: quality rules by cross-document line frequency.

One pass over the texts (numpy over Arrow) gives each row its word counts, the within-text repetition figures
of the base rules, and the 64-bit hashes of its normalised lines (A-Z folded, white space collapsed) with the
number of words in each. From then on only these few numbers move:

1. distinct (host, line, document) are counted by (host, line) with map-side partial sums;
2. a line is *boilerplate of its host* when it stands in at least ``most_docs`` documents, however large the host is; or in
   at least ``min_docs`` and in more than ``share`` of the host's documents; or, in a host of fewer than ``min_docs``
   documents, in at least ``SMALL_DOCS`` and in more than ``SMALL_SHARE`` of them;
3. boilerplate lines are removed; a document with less than ``keep_words`` of its words left is depleted.

Verdict: base rules passed and not depleted. Rows are never merged: repeated ids and repeated texts stay
separate rows, and each counts as a document of its host. Null text has no words and fails the base rules;
null hosts form one host. A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, stored
from .textvec import SPACE, Block, blocks, mix, per_text, range_hash, windows

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
MIN_DOCS = 20
SHARE = 0.10
KEEP_WORDS = 0.5
#: In so many documents of its host a line is boilerplate, whatever share they are.
MOST_DOCS = 20
#: Hosts of fewer than min_docs documents.
SMALL_DOCS, SMALL_SHARE = 3, 0.5

_FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_hash array<long>, line_words array<int>"
)


def _line_words(block: Block, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: byte starts and ends, text index, first word and word past the last."""
    line_starts, line_ends = block.line_spans()
    a, b = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    full = b > a
    line_starts, line_ends, a, b = line_starts[full], line_ends[full], a[full], b[full]
    return line_starts, line_ends, np.searchsorted(block.off, line_starts, "right") - 1, a, b


def block_features(block: Block) -> dict[str, np.ndarray]:
    n = block.n
    starts, ends, owner = block.word_spans()
    words = block.span_hash(starts, ends)
    out = {"n_words": per_text(owner, n)}

    def by_bytes(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[block.off[1:]] - sums[block.off[:-1]]

    out["word_chars"] = by_bytes(~SPACE[block.data] & ((block.data & 0xC0) != 0x80))
    out["n_symbols"] = by_bytes(SYMBOLS[block.data])

    line_starts, line_ends, line_owner, a, b = _line_words(block, starts)
    exact = mix(block.span_hash(line_starts, line_ends) ^ (line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    firsts = np.unique(exact, return_index=True)[1]
    out["n_dup_lines"] = per_text(line_owner, n) - per_text(line_owner[firsts], n)

    grams, first = windows(words, owner, WINDOW)
    key = mix(grams ^ (owner[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + WINDOW, -1)
    out["n_repeat_words"] = per_text(owner[np.cumsum(cover[:-1]) > 0], n)

    folded = block.span_hash(starts, ends, fold=True)
    out["line_hash"] = range_hash(folded, a, b).view(np.int64)
    out["line_words"] = (b - a).astype(np.int32)
    out["line_off"] = np.concatenate([[0], np.cumsum(per_text(line_owner, n))]).astype(np.int32)
    return out


_NAMES = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words", "n_removed_words", "removed", "base_failed", "kept"}


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, then the figures of each row's text."""
    keep = [F.col(c) for c in df.columns if c != text_col]
    source = df.select(*keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    names = [f.name for f in source.schema[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for block in blocks(batch.column(at)):
                f = block_features(block)
                rows = batch.slice(block.first, block.n)
                lists = [pa.ListArray.from_arrays(pa.array(f["line_off"]), pa.array(f[c])) for c in ("line_hash", "line_words")]
                plain = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:at], *(pa.array(f[c]) for c in plain), *lists],
                    names=[*names, *plain, "line_hash", "line_words"],
                )

    return in_arrow(source, run, f"{schema}, {_FEATURES}" if schema else _FEATURES)


def frequent_lines(figures: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, line) over the limits; figures has the columns __host and line_hash."""
    hosts = figures.groupBy("__host").agg(F.count("*").alias("docs"))
    lines = (
        figures.select("__host", F.explode(F.array_distinct("line_hash")).alias("line"))
        .groupBy("__host", "line")
        .agg(F.count("*").alias("in_docs"))
        .filter(F.col("in_docs") >= min(min_docs, most_docs, SMALL_DOCS))
    )
    of_many = (F.col("in_docs") >= min_docs) & (F.col("in_docs") > share * F.col("docs"))
    of_few = (F.col("docs") < min_docs) & (F.col("in_docs") >= SMALL_DOCS) & (F.col("in_docs") > SMALL_SHARE * F.col("docs"))
    return (
        lines.alias("l")
        .join(hosts.alias("h"), F.col("l.__host").eqNullSafe(F.col("h.__host")))
        .filter((F.col("in_docs") >= most_docs) | of_many | of_few)
        .select(F.col("l.__host").alias("__host"), "line")
    )


def verdicts(
    df: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    share: float = SHARE,
    keep_words: float = KEEP_WORDS,
    most_docs: int = MOST_DOCS,
) -> DataFrame:
    """Every row of df without its text, with its figures, ``removed`` (array of the boilerplate line hashes in it), ``n_removed_words``,
    ``base_failed`` and ``kept``. Columns of df that bear one of these names are left out. A null host is a host of its own; an empty table gives no rows."""
    others = [c for c in df.columns if c == text_col or c not in _NAMES]
    figures = stored(
        features(
            df.select(*others, F.col(host_col).alias("__host"), F.monotonically_increasing_id().alias("__row")), text_col
        ),
        "figures",
    )
    frequent = frequent_lines(figures, min_docs, share, most_docs).withColumn("__known", F.lit(True))
    lines = figures.select("__row", "__host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x")).select(
        "__row", "__host", F.col("x.line_hash").alias("line"), F.col("x.line_words").alias("words")
    )
    removed = (
        lines.alias("a")
        .join(
            frequent.alias("b"),
            (F.col("a.line") == F.col("b.line")) & F.col("a.__host").eqNullSafe(F.col("b.__host")),
            "left_semi",
        )
        .groupBy("__row")
        .agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed"))
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        figures.join(removed, "__row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (left >= keep_words * F.col("n_words")))
    )


def apply(df: DataFrame, text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The kept rows with df's columns; boilerplate lines are gone from their texts, and ``n_chars``, if there, follows.

    Text is matched back by a row number that is written first, so repeated rows stay apart.
    """
    numbered = stored(df.withColumn("__n", F.monotonically_increasing_id()), "rows")
    judged = verdicts(numbered.select("__n", text_col, host_col), text_col, host_col, **limits)
    judged = judged.filter("kept").select("__n", F.col("removed").alias("__removed"))
    clean = numbered.filter(F.col(text_col).isNotNull()).join(judged, "__n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema)
    names = clean.columns
    at, drop = names.index(text_col), names.index("__removed")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array(_without(batch.column(at), batch.column(drop)), batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = in_arrow(clean, run, schema).drop("__n", "__removed")
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.char_length(text_col).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def _without(texts: pa.Array, removed: pa.Array) -> list[str]:
    out = texts.to_pylist()
    for block in blocks(texts):
        some = [i for i in range(block.n) if removed[block.first + i].is_valid]
        if not some:
            continue
        starts, ends, _ = block.word_spans()
        line_starts, line_ends, owner, a, b = _line_words(block, starts)
        hashes = range_hash(block.span_hash(starts, ends, fold=True), a, b).view(np.int64)
        for i in some:
            bad = set(removed[block.first + i].as_py())
            raw = block.data[block.off[i] : block.off[i + 1]].tobytes()
            lo, hi = np.searchsorted(owner, i), np.searchsorted(owner, i, "right")
            gone = {int(line_starts[k] - block.off[i]) for k in range(lo, hi) if int(hashes[k]) in bad}
            kept, at = [], 0
            for line in raw.split(b"\n"):
                if at not in gone:
                    kept.append(line)
                at += len(line) + 1
            out[block.first + i] = b"\n".join(kept).decode()
    return out
