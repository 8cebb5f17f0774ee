"""Operator 11: alignment of the tokens of two vocabularies over the same text.

A is a byte-level BPE file of ``tokenizers``, B a sentencepiece BPE file with byte fallback. Both code a space and the text. A text is cut into
segments before every run of white space that begins with a *break character*: one that no token of A and no piece of B holds after
anything but white space (``break_characters`` reads that from the vocabularies), so that no merge and no token can reach over the cut; A's
own pre-tokens end there as well. Each distinct segment of the corpus is tokenised and aligned once:

1. texts are read in blocks of about ``BLOCK_CHARS`` characters; a block keeps its distinct segments and, for each document, their numbers;
2. the segments of all blocks, put together by their hash, are encoded by A and B, equal ones once (once a batch, if they fill batches); byte offsets where tokens of
   both end cut them into groups, overlapping byte ranges link A tokens to B tokens;
3. the alignments join the blocks that hold their segment, which compose their documents' groups and count for each linked pair of ids their documents;
4. the corpus-wide counts of its pairs come back to each block, and the last two figures are sums over a document's segments.

What moves are distinct segments and pairs of blocks, never one row for each word of a document.

Every row counts as a document, also repeated ones and those without an id. Null and empty texts, and texts whose joined A or B bytes differ
from space and text (such as those with U+2581), have no tokens: zeros, and no groups. An empty table gives no rows. A text is read in runs
of segments, so a long one takes some 4 bytes a segment; a part of it without a break character is one segment. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import _field
from .shared import discard, in_arrow, stored

#: Characters of texts, and distinct segments, at which a block ends.
BLOCK_CHARS, BLOCK_SEGMENTS = 1 << 24, 1 << 19
#: Segments in a row of a block.
LISTED = 1 << 15
#: Segments of a text that are in hand as strings at once, and segments that are tokenised at once.
RUN, BATCH = 200_000, 4096
#: What travels between tasks is compressed with this much care: disk is scarcer than time here.
LEVEL = 7
#: Rows, or their bytes, of segments that a task has in hand together.
TOGETHER, TOGETHER_BYTES = 1 << 16, 1 << 23
#: Segments of documents whose pairs are sorted together.
SORTED = 1 << 16
#: Documents in a batch of results.
OUT_ROWS = 1000
BREAKS = " \n\t\r\x0b\x0c"
MARK = "▁"
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def _byte_level() -> dict[str, int]:
    """Stand-in character to byte, by the rule of byte-level vocabularies: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (message[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 0x80:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


def is_identity(model: bytes) -> bool:
    """Whether a sentencepiece model leaves texts as they are but for a space before them and U+2581 for spaces."""
    spec: dict[int, int | bytes] = {}
    for number, value in _fields(model):
        if number == 3:
            spec |= dict(_fields(value))
    # name, table of characters, dummy prefix, removal of spaces, escape of spaces; the last three are on unless they are set
    return spec.get(1) == b"identity" and not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class Pair:
    """Both tokenizers and the bytes of their tokens; lives in a Python worker."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True  # their strings in a text are text
        # a later field of the same name wins: no space is put before a segment, the text's own is in it
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model + _field(3, _field(3, 0)))
        byte_of = _byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in token)
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])


def break_characters(a_json: str, b_model: bytes) -> str:
    """The white space before which no token of either vocabulary can begin earlier; none if a normaliser could reach over a cut."""
    import json

    spec = json.loads(a_json)
    cuts = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or cuts.get("type") != "ByteLevel" or not cuts.get("use_regex", True) or not is_identity(b_model):
        return ""
    pair, joined = Pair(a_json, b_model), set()
    for token in (*pair.a_bytes, *pair.b_bytes):
        chars = token.decode(errors="replace")
        joined.update(after for before, after in zip(chars, chars[1:], strict=False) if not before.isspace())
    return "".join(c for c in BREAKS if c not in joined)


def segment_pattern(breaks: str) -> re.Pattern:
    """Matches of the pattern lie end to end and cover any text."""
    if not breaks:
        return re.compile(r"(?s).+")
    return re.compile(rf"\s*+\S++(?:[^\S{re.escape(breaks)}]\s*+\S*+)*+|\s++")


@cache
def _pattern(breaks: str) -> re.Pattern:
    return segment_pattern(breaks)


def _pack(*parts: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers or of bytes, one after the other, compressed: lowest bytes first, for small numbers have the others in common."""
    raw = [p if p.dtype == np.uint8 else np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T) for p in parts]
    whole = np.array([p.nbytes for p in raw], "<u8").tobytes() + b"".join(p.tobytes() for p in raw)
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(whole, asbytes=True)


def _unpack(cell: pa.Scalar, count: int, text: bool = False) -> list[np.ndarray]:
    """The arrays of _pack; text: the last is of bytes."""
    packed = cell.as_buffer()
    data = np.frombuffer(pa.decompress(packed.slice(8), int.from_bytes(packed.slice(0, 8).to_pybytes(), "little"), "zstd"), np.uint8)
    ends = 8 * count + np.cumsum(data[: 8 * count].view("<u8")).astype(np.int64)
    parts = [data[a:b] for a, b in zip([8 * count, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    numbers = parts[:-1] if text else parts
    return [np.ascontiguousarray(p.reshape(4, -1).T).view("<u4").ravel() for p in numbers] + (parts[-1:] if text else [])


def _release() -> None:
    """Gives freed memory back to the system, for a worker keeps it from one task to the next."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Numbers(dict):
    """Numbers strings in the order in which they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _numbered(text: str, pattern: re.Pattern, numbers: Numbers) -> np.ndarray:
    """Numbers of the segments of a space and the text."""
    whole = " " + text
    if len(whole) < 4 * RUN:
        return np.array(list(map(numbers.__getitem__, pattern.findall(whole))), dtype=np.uint32)
    found, runs = (m.group() for m in pattern.finditer(whole)), []
    while run := list(islice(found, RUN)):
        runs.append(np.array(list(map(numbers.__getitem__, run)), dtype=np.uint32))
    return np.concatenate(runs)


def blocks(df: DataFrame, breaks: str, id_col: str, text_col: str) -> DataFrame:
    """(block, at, ids, sizes, marks, segments): distinct segments of some documents, in rows of some from number ``at`` on, and in a block's first row for
    each document the numbers of its segments, end to end."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"block long, at int, ids array<{kind}>, sizes array<int>, marks binary, segments array<string>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pattern(breaks)
        number = TaskContext.get().partitionId() << 32
        ids, marks, numbers, chars = [], [], Numbers(), 0

        def block() -> Iterator[pa.RecordBatch]:
            found, kinds = np.concatenate(marks), np.array(list(numbers), dtype=object)
            often = np.argsort(-np.bincount(found, minlength=len(kinds)), kind="stable")
            rank = np.empty(len(kinds), np.uint32)
            rank[often] = np.arange(len(kinds))  # frequent segments get small numbers
            kinds = kinds[often]
            for at in range(0, max(1, len(kinds)), LISTED):
                some, first = kinds[at : at + LISTED].tolist(), at == 0
                own = [
                    pa.ListArray.from_arrays([0, len(ids)], pa.array(ids, id_type)),
                    pa.array([[len(m) for m in marks]], pa.list_(pa.int32())),
                    pa.array([_pack(rank[found])], pa.binary()),
                ] if first else [pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary())]
                columns = [pa.array([number]), pa.array([at], pa.int32()), *own, pa.array([some], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "ids", "sizes", "marks", "segments"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py() or ""
                ids.append(key)
                marks.append(_numbered(text, pattern, numbers) if text else np.zeros(0, np.uint32))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(numbers) >= BLOCK_SEGMENTS:
                    yield from block()
                    number += 1
                    ids, marks, numbers, chars = [], [], Numbers(), 0
                    _release()
        if ids:
            yield from block()
            ids, marks, numbers = [], [], Numbers()
        _release()

    return in_arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


_PAIRS: dict[str, Pair] = {}


def _pair(shared: Broadcast, name: str) -> Pair:
    """Built once in each Python worker."""
    if name not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[name] = Pair(*shared.value)
    return _PAIRS[name]


def _aligned(segments: list[str], pair: Pair) -> pa.Table:
    """Alignment of each segment; their tokens are laid end to end, so that offsets of all are compared at once. Without tokens if the bytes differ."""
    raw = [s.encode() for s in segments]
    a = [e.ids for e in pair.a.encode_batch(segments, add_special_tokens=False)]
    b = pair.b.encode(segments, num_threads=1)
    ok = [b"".join(map(pair.a_bytes.__getitem__, x)) == r == b"".join(map(pair.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)]
    a = [x if fine else [] for x, fine in zip(a, ok, strict=True)]
    b = [x if fine else [] for x, fine in zip(b, ok, strict=True)]
    n = len(segments)
    a_owner, b_owner = np.repeat(np.arange(n), [len(x) for x in a]), np.repeat(np.arange(n), [len(x) for x in b])
    a_ids = np.fromiter((i for x in a for i in x), np.int64, len(a_owner))
    b_ids = np.fromiter((i for x in b for i in x), np.int64, len(b_owner))
    a_end, b_end = np.cumsum(pair.a_sizes[a_ids]), np.cumsum(pair.b_sizes[b_ids])
    a_start, b_start = a_end - pair.a_sizes[a_ids], b_end - pair.b_sizes[b_ids]
    # links: the B tokens from the first that ends after an A token begins to the last that begins before it ends
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
    width = last - first
    link_a = np.repeat(np.arange(len(a_ids)), width)
    link_b = np.arange(len(link_a)) + np.repeat(first - np.cumsum(width) + width, width)
    offsets = np.searchsorted(a_owner[link_a], np.arange(n + 1))
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    a_upto, b_upto = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
    owner = a_owner[a_upto - 1]
    a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    spelled: list[list[str]] = [[] for _ in range(n)]
    i = j = 0
    for k, i_end, j_end in zip(owner.tolist(), a_upto.tolist(), b_upto.tolist(), strict=True):
        spelled[k].append(f"{','.join(a_text[i:i_end])}|{','.join(b_text[j:j_end])}")
        i, j = i_end, j_end
    count = lambda x: pa.array(np.bincount(x, minlength=n), pa.int32())
    return pa.table(
        {
            "n_a": count(a_owner),
            "n_b": count(b_owner),
            "n_groups": count(owner),
            "groups": pa.array([";".join(x) for x in spelled]),
            "links": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(a_ids[link_a] << 32 | b_ids[link_b])),
        }
    )


def aligned_segments(segments: DataFrame, a_json: str, b_model: bytes) -> DataFrame:
    """Segments (block, place, segment) -> (block, aligned): packed for the segments of a block that meet in a run of rows, their places, numbers
    of tokens, groups and links, the linked ids as often as they are linked, and the groups."""
    shared = segments.sparkSession.sparkContext.broadcast((a_json, b_model))  # the files, some MB whatever the corpus
    name = hashlib.sha256(a_json.encode() + b_model).hexdigest()

    def rows_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        coded = whole.column("segment").combine_chunks().dictionary_encode()
        kinds, pair = coded.dictionary.to_pylist(), _pair(shared, name)
        aligned = pa.concat_tables([_aligned(kinds[at : at + BATCH], pair) for at in range(0, len(kinds), BATCH)]).combine_chunks()
        block = whole.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        rows = aligned.take(pa.array(coded.indices.to_numpy()[order])).combine_chunks()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
        links = rows.column("links").combine_chunks()
        link_cuts, linked = links.offsets.to_numpy() - links.offsets[0].as_py(), links.flatten().to_numpy()
        text = rows.column("groups").combine_chunks().cast(pa.binary())
        text_cuts = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        spelled = np.frombuffer(text.buffers()[2], np.uint8)
        place = whole.column("place").to_numpy()[order]
        counts = [rows.column(f).to_numpy() for f in ("n_a", "n_b", "n_groups")] + [np.diff(link_cuts)]
        packed = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = linked[link_cuts[lo] : link_cuts[hi]]
            numbers = [place[lo:hi], *(c[lo:hi] for c in counts), some >> 32, some & 0xFFFFFFFF, np.diff(text_cuts[lo : hi + 1])]
            packed.append(_pack(*numbers, spelled[text_cuts[lo] : text_cuts[hi]]))
        return pa.RecordBatch.from_arrays([pa.array(block[order][cuts[:-1]]), pa.array(packed, pa.binary())], names=["block", "aligned"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER or sum(b.nbytes for b in held) >= TOGETHER_BYTES:
                yield rows_of(held)
                held = []
        if any(b.num_rows for b in held):
            yield rows_of(held)
        _release()

    together = segments.select("block", "place", "segment").repartition(F.xxhash64("segment")).sortWithinPartitions(F.xxhash64("segment"))
    return in_arrow(together, run, "block long, aligned binary")


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        number = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and number[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = number[lo]
    if held:
        yield pa.Table.from_batches(held)


def _numbers(cell: pa.Scalar) -> np.ndarray:
    """A list cell as an array."""
    return cell.values.to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values that lie end to end."""
    so_far = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return so_far[ends] - so_far[ends - sizes]


_COMPOSED = "sizes array<int>, held binary, pairs array<long>, docs array<long>, " + ", ".join(f"{f} array<long>" for f in FIGURES)


def composed(held: DataFrame, alignments: DataFrame, hashed: bool) -> DataFrame:
    """For each block its ids; of each document the segments' numbers, the figures that need no counts, and the groups or their SHA-256; the distinct
    linked pairs with their documents in the block; and which of the pairs each segment holds."""
    kind = held.schema["ids"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(batches):
            own = {n: next(c for c in rows.column(n) if c.is_valid) for n in ("block", "ids", "sizes", "marks")}
            sizes, (marks,) = _numbers(own["sizes"]), _unpack(own["marks"], 1)
            ends = np.cumsum(sizes)
            _release()
            runs = [_unpack(c, 9, text=True) for c in rows.column("aligned") if c.is_valid] or [[np.zeros(0, "<u4")] * 8 + [np.zeros(0, np.uint8)]]
            place, *figures_, link_a, link_b, lengths, spelled = map(np.concatenate, zip(*runs, strict=True))
            del runs
            order = np.argsort(place)
            n_a, n_b, n_groups, n_links = (x[order].astype(np.int64) for x in figures_)
            text_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            groups = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(text_ends), pa.py_buffer(spelled)])
            groups = groups.take(pa.array(order)).to_pylist()
            fine = _sums(n_a[marks] == 0, ends, sizes) == 0
            pairs, coded = np.unique(link_a.astype(np.int64) << 32 | link_b, return_inverse=True)
            often = np.argsort(-np.bincount(coded, minlength=len(pairs)), kind="stable")
            rank = np.empty(len(pairs), np.int64)
            rank[often] = np.arange(len(pairs))  # frequent pairs get small numbers
            pairs, coded = pairs[often], rank[coded]
            came = np.cumsum(figures_[3], dtype=np.int64)[order] - n_links  # where a segment's links begin as they came
            starts = np.concatenate([[0], np.cumsum(n_links, dtype=np.int64)])
            local = coded[np.arange(starts[-1]) + np.repeat(came - starts[:-1], n_links)]
            figures = [_sums(x[marks], ends, sizes) * fine for x in (n_a, n_b, n_groups, n_links)]
            spelled = [_spelled(groups, marks[e - n : e] if ok else marks[:0], hashed) for e, n, ok in zip(ends.tolist(), sizes.tolist(), fine.tolist(), strict=True)]
            lists = {
                "ids": own["ids"].values,
                "sizes": pa.array(sizes, pa.int32()),
                "pairs": pa.array(pairs, pa.int64()),
                "docs": pa.array(_documents(local, starts, marks, sizes, fine, len(pairs)), pa.int64()),
                **{f: pa.array(x, pa.int64()) for f, x in zip(FIGURES, figures, strict=True)},
                "groups": pa.array(spelled, pa.string()),
            }
            columns = {"block": pa.array([own["block"].as_py()])}
            columns |= {n: _lists(np.array([0, len(x)]), x) for n, x in lists.items()}
            columns["held"] = pa.array([_pack(marks, n_links, local)], pa.binary())
            names = ["block", "ids", *(f.split(" ")[0] for f in _COMPOSED.split(", ")), "groups"]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    both = alignments.unionByName(held.filter("at = 0").select("block", "ids", "sizes", "marks"), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block")
    return in_arrow(met, run, f"block long, ids {kind}, {_COMPOSED}, groups array<string>")


def _documents(local: np.ndarray, starts: np.ndarray, marks: np.ndarray, sizes: np.ndarray, fine: np.ndarray, n: int) -> np.ndarray:
    """How many documents hold each of n pairs; some documents at a time, so that what is sorted is short."""
    total, ends = np.zeros(n, np.int64), np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        began = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, began + SORTED, "right")))
        kept = np.repeat(fine[lo:hi], sizes[lo:hi])
        which, who = marks[began : ends[hi - 1]][kept], np.repeat(np.arange(hi - lo), sizes[lo:hi])[kept]
        first, width = starts[which], starts[which.astype(np.int64) + 1] - starts[which]
        at = np.arange(width.sum()) + np.repeat(first - np.cumsum(width) + width, width)
        both = np.unique(np.repeat(who, width) << 32 | local[at])
        total += np.bincount(both & 0xFFFFFFFF, minlength=n)
        lo = hi
    return total


def pair_counts(blocks_: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold each pair linked, and whether no other pair of its A id has more."""
    partial = blocks_.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = partial.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an A id has at most as many pairs as B has ids
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == most).cast("long").alias("best"))


def counted(blocks_: DataFrame, counts: DataFrame, last: str) -> DataFrame:
    """The rows of documents: with the counts of a block's pairs its segments have sums, and its documents theirs."""
    kind = blocks_.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {n: batch.column(n)[k] for n in batch.schema.names}
                sizes, (marks, width, local) = _numbers(own["sizes"]), _unpack(own["held"], 3)
                ends, figures = np.cumsum(sizes), [_numbers(own[f]) for f in FIGURES]
                width = width.astype(np.int64)
                link_ends, fine = np.cumsum(width), figures[0] > 0
                place = _numbers(own["place"]) if own["place"].is_valid else np.zeros(0, np.int32)
                for name in ("best", "docs"):
                    of_pair = np.zeros(len(place), np.int64)
                    if len(place):
                        of_pair[place] = _numbers(own[name])
                    of_segment = _sums(of_pair[local], link_ends, width)
                    figures.append(_sums(of_segment[marks], ends, sizes) * fine)
                ids, groups = own["ids"].values, own["groups"].values
                for at in range(0, len(sizes), OUT_ROWS):
                    some = slice(at, at + OUT_ROWS)
                    columns = [ids.slice(at, OUT_ROWS), *(pa.array(f[some], pa.int64()) for f in figures), groups.slice(at, OUT_ROWS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIGURES, "n_best", "count_sum", last])

    places = blocks_.select("block", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    # as many as a block has distinct pairs
    listed = places.groupBy("block").agg(F.collect_list(F.struct("place", "docs", "best")).alias("p"))
    listed = listed.select("block", *(F.col(f"p.{c}").alias(c) for c in ("place", "docs", "best")))
    met = blocks_.drop("pairs", "docs").join(listed, "block", "left").drop("block")
    schema = f"doc_id {kind}, " + ", ".join(f"{f} long" for f in [*FIGURES, "n_best", "count_sum"]) + f", {last} string"
    return in_arrow(met, run, schema)


def _spelled(groups: list[bytes], marks: np.ndarray, hashed: bool) -> str:
    if not len(marks):
        return ""
    if not hashed:
        return b";".join(map(groups.__getitem__, marks.tolist())).decode()
    sha = hashlib.sha256()
    for at in range(0, len(marks), RUN):
        if at:
            sha.update(b";")
        sha.update(b";".join(map(groups.__getitem__, marks[at : at + RUN].tolist())))
    return sha.hexdigest()


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    a_json, b_model = _read(a_path).decode(), _read(b_path)
    held = stored(blocks(df, break_characters(a_json, b_model), id_col, text_col), "blocks", lean=True)
    segments = held.select("block", "at", F.posexplode("segments").alias("place", "segment"))
    segments = segments.select("block", (F.col("at") + F.col("place")).alias("place"), "segment")
    whole = stored(composed(held, aligned_segments(segments, a_json, b_model), hashed), "composed", lean=True)
    discard(held)
    return counted(whole, stored(pair_counts(whole), "counts", lean=True), "groups_sha256" if hashed else "groups")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row; groups as ``a1,a2|b1;a3|b2,b3``."""
    return _run(df, a_path, b_path, id_col, text_col, hashed=False)


def digest(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As align(), with the SHA-256 of the groups in place of them; '' without tokens."""
    return _run(df, a_path, b_path, id_col, text_col, hashed=True)
