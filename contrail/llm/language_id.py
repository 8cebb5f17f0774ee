"""Operator 8: language identification by prediction by partial matching.

Per language a variable-order byte context tree (orders 0 to 3) is counted once on a bounded labelled sample
and then frozen. A byte seen c times after a context with T bytes of D kinds costs ``-log2(c / (T + D))`` bits
(escape method C); an unseen byte pays the escape ``D / (T + D)`` and is coded by the next shorter context with
the kinds already ruled out excluded (renormalised); below order 0 the unseen byte values are equally likely.
A context that a language never saw costs nothing to leave. So every byte of every text has an exact code
length under every language; the shortest total wins and ``score`` is its share of ``2 ** -bits`` over all
languages. A-Z count as a-z; each text starts after three line feeds.

Bound of the sample: at most about ``SAMPLE_DOCS`` documents of up to ``SAMPLE_BYTES`` bytes for each label,
picked by a hash of the id; longer documents are not in the sample, but for labels that have no others: of those, documents of up to twice the shortest one's size
are taken, as many fewer as they are longer, and one at least. So all labels are learned, and all contexts in the sample. A tree holds what its language
showed and no more, and the runs of four bytes that a part of a text holds are looked up once for each language.
Prediction reads whole texts. An empty table gives no rows. Null text, or text without a letter: ``und`` with score 0; so does everything
if nothing was learned. Ties go to the alphabetically first language. Repeated rows are predicted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, stored
from .textvec import Block, blocks

ORDER = 3
SAMPLE_DOCS = 800
SAMPLE_BYTES = 20_000
#: Labels up to which their sizes are broadcast.
FEW_LABELS = 10_000
#: Bytes of texts that are coded at once.
PART_BYTES = 1 << 20
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _parts(block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(place, grams) of parts of a block: for each byte the run of ORDER + 1 lower-cased bytes that ends there, packed big-endian."""
    size, opens = len(block.data), block.off[:-1]
    for lo in range(0, size, PART_BYTES):
        hi = min(size, lo + PART_BYTES)
        left = block.data[max(0, lo - ORDER) : lo]
        wide = np.concatenate([np.full(ORDER - len(left), 10, np.uint8), _LOWER[left], _LOWER[block.data[lo:hi]]]).astype(np.uint32)
        before = [wide[ORDER - k : len(wide) - k].copy() for k in range(1, ORDER + 1)]
        for j in range(ORDER):  # the bytes before a text are line feeds
            at = opens + j - lo
            at = at[(at >= 0) & (at < hi - lo)]
            for k in range(j, ORDER):
                before[k][at] = 10
        yield lo, (before[2] << 24) | (before[1] << 16) | (before[0] << 8) | wide[ORDER:]


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text) of the bounded labelled sample."""
    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.octet_length(text_col).cast("long").alias("size"), F.xxhash64(F.col(id_col).cast("string")).alias("h")
    )
    figures = stored(known.drop("text"), "figures")
    shortest = figures.groupBy("lang").agg(F.when(F.min("size") > SAMPLE_BYTES, 2 * F.min("size")).otherwise(SAMPLE_BYTES).alias("most"))
    fit = figures.join(shortest, "lang").filter(F.col("size") <= F.col("most"))
    sizes = stored(fit.groupBy("lang").agg(F.first("most").alias("most"), F.count("*").alias("count"), F.min("h").alias("least")), "sizes")
    if sizes.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sizes = F.broadcast(sizes)
    # a uniform 64-bit hash below its share of the range
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE_DOCS * SAMPLE_BYTES)) / F.col("most") / F.col("count"))
    return (
        known.join(sizes, "lang")
        .filter((F.col("size") <= F.col("most")) & ((F.col("h") == F.col("least")) | (F.col("h").cast("double") <= share * F.lit(2.0**64) - F.lit(2.0**63))))
        .select("lang", "text")
    )


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): runs of ORDER + 1 bytes, packed big-endian in a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], dtype=np.int64)
            for block in blocks(batch.column(1), PART_BYTES):
                owner = np.repeat(code[block.first : block.first + block.n], np.diff(block.off))
                for at, grams in _parts(block):
                    values, counts = np.unique(owner[at : at + len(grams)] << 32 | grams, return_counts=True)
                    merged, inverse = np.unique(np.concatenate([total[0], values]), return_inverse=True)
                    total = merged, np.bincount(inverse, np.concatenate([total[1], counts])).astype(np.int64)
        for lang, k in langs.items():
            own = slice(*np.searchsorted(total[0], [k << 32, (k + 1) << 32]))
            values = total[0][own] & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(total[1][own])], names=["lang", "gram", "n"])

    return in_arrow(labelled, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Frozen counts of one language: for each order its runs and its contexts, sorted."""

    def __init__(self, grams: np.ndarray, n: np.ndarray) -> None:
        self.orders = []
        lower = None
        for order in range(ORDER + 1):
            keys, inverse = np.unique(grams & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(inverse, n, minlength=len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(of, counts), np.bincount(of)
            whole = kinds == 256  # nothing is left to escape to
            p = counts / np.where(whole, total, total + kinds)[of]
            below = np.full(len(keys), 1 / 256) if lower is None else lower[1][np.searchsorted(lower[0], keys & ((1 << 8 * order) - 1))]
            spare = np.where(whole, 1.0, 1 - np.bincount(of, below))
            escape = np.where(whole, 0.0, kinds / (total + kinds) / spare)
            lower = keys, p
            self.orders.append((keys, p, contexts, escape))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each run after the others."""
        p = np.full(len(grams), 1 / 256)
        for order, (keys, seen, contexts, escape) in enumerate(self.orders):
            key = grams & ((1 << 8 * (order + 1)) - 1)
            for sorted_, values, wanted, escaped in ((contexts, escape, key >> 8, True), (keys, seen, key, False)):
                at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
                hit = sorted_[at] == wanted
                p[hit] = p[hit] * values[at[hit]] if escaped else values[at[hit]]
        return -np.log2(p)


class Model:
    """Frozen code lengths; built from sparse counts in each Python worker."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[lang]) for lang in self.langs]

    def code_lengths(self, block: Block) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((block.n, max(1, len(self.langs))))
        for lo, grams in _parts(block):
            coded = pa.array(grams).dictionary_encode()
            kinds, place = coded.dictionary.to_numpy().astype(np.int64), coded.indices.to_numpy()
            first, last = np.searchsorted(block.off, lo, "right") - 1, np.searchsorted(block.off, lo + len(grams), "left")
            opens = np.maximum(block.off[first:last], lo) - lo
            full = np.flatnonzero(np.diff(np.append(opens, len(grams))))
            for k, tree in enumerate(self.trees):
                out[first + full, k] += np.add.reduceat(tree.bits(kinds)[place], opens[full])
        return out


_MODELS: dict[str, Model] = {}


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Sparse counts by language: what the workers build the frozen model from. Bounded by the sample."""
    pdf = gram_counts(sample(train, id_col, text_col, lang_col)).toPandas()
    return {
        str(lang): (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.int64)) for lang, g in pdf.groupby("lang", sort=True)
    }


def predict(df: DataFrame, counts: dict, text_col: str = "text") -> DataFrame:
    """df's columns without the text, then ``lang_pred`` and ``score``."""
    spark = df.sparkSession
    name = hashlib.sha256(
        b"".join(lang.encode() + g.tobytes() + n.tobytes() for lang, (g, n) in sorted(counts.items()))
    ).hexdigest()
    shared = spark.sparkContext.broadcast(counts)
    keep = [F.col(c) for c in df.columns if c != text_col]
    source = df.select(*keep, F.col(text_col).rlike(r"\p{L}").alias("__letter"), F.col(text_col).alias("__text"))
    fields = source.schema[:-2]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(shared.value)
        model = _MODELS[name]
        for batch in batches:
            at = batch.num_columns - 1
            for block in blocks(batch.column(at), PART_BYTES):
                rows = batch.slice(block.first, block.n)
                letter = np.array([bool(x) for x in rows.column(at - 1).to_pylist()]) & bool(model.langs)
                bits = model.code_lengths(block)
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[: at - 1], pa.array(langs), pa.array(np.where(letter, score, 0.0))],
                    names=[*names, "lang_pred", "score"],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return in_arrow(source, run, schema + "lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the ids, by crc32; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from the labelled rows that are not held out."""
    counts = fit(df.filter(~held_out(id_col)), id_col, text_col, lang_col)
    kept = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(kept, counts)


def apply(df: DataFrame, least_score: float = 0.5) -> DataFrame:
    """df's rows whose language is known with the least score; ``lang`` is the predicted one."""
    counts = fit(df.filter(~held_out()))
    rows = df.withColumn("__copy", F.col("text"))
    out = predict(rows, counts, "__copy").filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return out.withColumn("lang", F.col("lang_pred").cast(df.schema["lang"].dataType)).select(*df.columns)
