"""Operator 9: lexical retrieval packing.

Texts are tokenised once and their ids written to the shared folder. The document frequencies and the mean length come from all documents of the
corpus, counted first. Documents are then dealt to shards by their strongest term (the largest BM25 weight among the terms that
other documents have too), so that lexical neighbours from anywhere in the corpus share a shard; a term with very many documents spreads over as many
shards as it fills. Every task cuts its rows into shards of at most ``SHARD_TOKENS`` ids (a longer document is a
shard of its own, and its full windows leave at once). A shard holds a BM25 inverted index of its documents. A window of
4096 is opened by the next unused document, all of whose terms query the index; the unused neighbours in the shard
fill the window greedily, best first, until it is full or none is left that shares a term, the last one cut to fit
and its rest left as an unused document. Where neighbours run out the next unused document follows. So every window but the shard's last is
full; the last one's ids are laid in windows whose lengths are powers of two and need no padding.

Rows with null text count as empty and consist of the end id alone; an empty table gives no rows. Repeated ids and texts stay separate pieces.
Equal scores fall to the earlier row of the shard, where rows are in the order of strongest term, hashed id and ids. ``sequence_id`` is unique over all partitions.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import FIRST_CHAR, serialised
from .shared import in_arrow, stored

WINDOW = 4096
END_ID = 2
#: A character between pre-tokens that no piece has.
BETWEEN = FIRST_CHAR + 512
SHARD_TOKENS = 1 << 21
#: Neighbours that are sorted at first; more follow while a window has room.
FIRST_BLOCK = 64
K1, B = 1.2, 0.75
#: Bytes of text, and documents, whose ids are in hand at once; a longer text is cut at spaces.
BLOCK_BYTES = 1 << 22
ROWS_AT_ONCE = 5000
#: Bytes of parts and ids that a Python worker remembers.
KNOWN_BYTES = 24 << 20
#: Characters that the merger gets at once.
RUN = 1 << 14
_SCHEMA = (
    "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class WordIds:
    """Token ids by space-separated part, which is exact for a vocabulary whose pre-tokens never cross white space.

    The distinct parts of a block of texts are encoded once, and kept until they take ``KNOWN_BYTES``. Parts of printable Latin-1, where case folding and normalisation are plain, are cut
    here and their pre-tokens merged by a sentencepiece model with the file's merge ranks as scores (see byte_bpe); all
    other parts, those that contain a special token, and files of another build go through the tokenizers library.
    """

    _PLAIN_ONLY = "^[!-~\u00a1-\u00ac\u00ae-\u00ff]+$"
    _PRE_TOKENS = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
        "|\n|[^\na-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+"
    )
    _BUILD = {
        "normalizer": ["NFC", "Replace", "Lowercase"],
        "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
        "suffix": "</w>",
    }

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.size = self.tokenizer.get_vocab_size()
        self.special: list[str] = []
        self._forget()
        self.merger = self._merger(json.loads(definition))

    def _merger(self, d: dict):  # noqa: ANN202
        """A sentencepiece processor with the same merges, or None for another kind of file."""
        splits = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        found = {
            "normalizer": [n["type"] for n in (d.get("normalizer") or {}).get("normalizers", [])],
            "pattern": splits[0].get("pattern", {}).get("Regex"),
            "suffix": d["model"].get("end_of_word_suffix"),
        }
        strict = any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in d["added_tokens"])
        if found != self._BUILD or strict:
            return None
        import sentencepiece

        from tokenizers.pre_tokenizers import ByteLevel

        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        assert set(byte) == set(ByteLevel.alphabet())
        end = "</w>"

        def spelled(token: str) -> str:
            last = token.endswith(end)
            raw = [byte[c] for c in token.removesuffix(end)]
            return "".join(chr(FIRST_CHAR + b) for b in raw[: len(raw) - last]) + (chr(FIRST_CHAR + 256 + raw[-1]) if last else "")

        vocab = d["model"]["vocab"]
        special = {t["content"] for t in d["added_tokens"]}
        self.special = sorted(special)
        rank = {"".join(m): -float(i + 1) for i, m in enumerate(x if isinstance(x, list) else x.split(" ") for x in d["model"]["merges"])}
        pieces = [(spelled(t), rank.get(t, 0.0), i) for t, i in vocab.items() if t not in special]
        self.ids = np.array([i for _, _, i in pieces] + [0], dtype="<u4")
        return sentencepiece.SentencePieceProcessor(model_proto=serialised([(t, s) for t, s, _ in pieces]))

    def _slow(self, parts: pa.Array) -> np.ndarray:
        """Which parts go through the library."""
        if self.merger is None:
            return np.ones(len(parts), dtype=bool)
        quick = pc.match_substring_regex(parts, self._PLAIN_ONLY).to_numpy(zero_copy_only=False)
        for token in self.special:
            quick &= ~pc.match_substring(parts, token).to_numpy(zero_copy_only=False)
        return ~quick

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and how many each has; all pre-tokens are merged in long runs, an unknown character between them."""
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), pa.scalar("\n", pa.large_string()))[0].as_py()
        cut = " ".join(self._PRE_TOKENS.findall(lines.lower())).replace(" \n ", "\n")
        raw = np.frombuffer(cut.encode(), dtype=np.uint8)
        gap = raw <= 0x20
        code = raw.astype("<u4") + FIRST_CHAR
        last = np.flatnonzero(np.append(gap[1:], True))
        code[last] += 256
        code[gap] = BETWEEN
        spelled, found = code.tobytes().decode("utf-32-le"), []
        at = 0
        while at < len(spelled):
            stop = spelled.find(chr(BETWEEN), at + RUN)
            stop = len(spelled) if stop < 0 else stop
            found += [*self.merger.encode(spelled[at:stop]), len(self.ids) - 1]
            at = stop + 1
        ids = np.array(found, dtype=np.int64)
        between = ids == len(self.ids) - 1
        part = np.concatenate([[0], np.cumsum(raw[gap] == 10)])  # of each pre-token
        owner = part[np.minimum(np.cumsum(between), len(part) - 1)][~between]
        return self.ids[ids[~between]], np.bincount(owner, minlength=len(parts))

    def _learned(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts end to end, and how many each has."""
        filled = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
        slow = filled & self._slow(parts)
        quick = filled & ~slow
        counts = np.zeros(len(parts), dtype=np.int64)
        flat = {}
        if quick.any():
            flat[1], counts[quick] = self._merged(parts.filter(pa.array(quick)))
        if slow.any():
            made = self.tokenizer.encode_batch_fast(parts.filter(pa.array(slow)).to_pylist(), add_special_tokens=False)
            counts[slow] = [len(e.ids) for e in made]
            flat[2] = np.array([i for e in made for i in e.ids], dtype="<u4")
        out = np.zeros(int(counts.sum()), dtype="<u4")
        kind = np.repeat(quick + 2 * slow, counts)
        for k, ids in flat.items():
            out[kind == k] = ids
        return out, counts

    def parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these distinct parts begin in ``flat``, and how many there are; new parts are learned."""
        if self.known.nbytes + len(self.flat) * 4 > KNOWN_BYTES:
            self._forget()
        new = parts.filter(pc.is_null(pc.index_in(parts, value_set=self.known)))
        ids, counts = self._learned(new)
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.flat, self.counts = np.concatenate([self.flat, ids]), np.concatenate([self.counts, counts])
        at = pc.index_in(parts, value_set=self.known).to_numpy()
        return self.starts[at], self.counts[at]

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.starts, self.counts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and their offsets."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
        starts, counts = self.parts(coded.dictionary)
        flat = np.append(self.flat, np.uint32(END_ID))
        starts, counts = np.append(starts, len(flat) - 1), np.append(counts, 1)
        part = np.insert(coded.indices.to_numpy().astype(np.int64), off[1:] - off[0], len(counts) - 1)
        size = counts[part]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[part] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends[np.cumsum(np.diff(off) + 1) - 1]])

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) of all texts, in blocks; null counts as empty."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            stop = min(max(int(np.searchsorted(ends, before + BLOCK_BYTES, "right")), at + 1), at + ROWS_AT_ONCE)
            if ends[at] - before > BLOCK_BYTES:
                pieces = [self.encode(pa.array([x]))[0] for x in _slices(texts[at].as_py())]
                ids = np.concatenate([*(x[:-1] for x in pieces), pieces[-1][-1:]])
                yield at, ids, np.array([0, len(ids)])
            else:
                yield at, *self.encode(texts.slice(at, stop - at))
            at = stop


def _slices(text: str) -> Iterator[str]:
    """A long text cut at spaces; a part without one stays whole."""
    at = 0
    while at < len(text):
        stop = text.find(" ", at + BLOCK_BYTES // 4)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop + 1


_WORD_IDS: dict[str, WordIds] = {}


def _word_ids(name: str, definition: str) -> WordIds:
    if name not in _WORD_IDS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _WORD_IDS.clear()
        _WORD_IDS[name] = WordIds(definition)
    return _WORD_IDS[name]


def tokenised(df: DataFrame, definition: str) -> DataFrame:
    """Writes (doc_id, ids, terms, counts) once, so that texts are tokenised once: a row per document with its ids as
    little-endian numbers of ``_id_type``, and a row per task with the terms that it saw and their document counts.

    Terms are numbered by the vocabulary; the next number counts documents, the one after tokens. A task sends one count for
    each entry that it saw, so their number does not grow with the corpus.
    """
    name = hashlib.sha256(definition.encode()).hexdigest()
    field = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(name, definition)
        kind = _id_type(ids.size)
        seen = np.zeros(ids.size + 2, dtype=np.int64)
        terms = pa.list_(pa.int64())
        names, none = ["doc_id", "ids", "terms", "counts"], None
        for batch in batches:
            none = batch.schema.field(0).type
            for first, own, off in ids.encoded(batch.column(1)):
                for i, j in zip(off[:-1], off[1:], strict=True):
                    seen[np.unique(own[i:j])] += 1
                n = len(off) - 1
                seen[-2:] += (n, len(own))
                raw = own.astype(kind)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off * raw.itemsize), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), held, pa.nulls(n, terms), pa.nulls(n, terms)], names=names)
        if none is not None:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, none), pa.nulls(1, pa.binary()), pa.array([at], terms), pa.array([seen[at]], terms)], names=names)

    return stored(in_arrow(df, run, f"doc_id {field}, ids binary, terms array<long>, counts array<long>"), "ids")


def _id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def document_frequencies(rows: DataFrame, size: int) -> tuple[int, float, np.ndarray]:
    """Documents, mean length and each id's document frequency, from the rows of tokenised()."""
    pair = F.explode(F.arrays_zip("terms", "counts")).alias("p")
    found = rows.filter("terms IS NOT NULL").select(pair).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))
    totals = found.toPandas()  # one row per vocabulary entry at most
    out = np.zeros(size + 2, dtype=np.int64)
    out[totals["term"].to_numpy(np.int64)] = totals["n"].to_numpy(np.int64)
    return int(out[-2]), float(out[-1] / max(1, out[-2])), out[:-2]


def weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a document and their BM25 weights."""
    term, tf = np.unique(ids, return_counts=True)
    norm = K1 * (1 - B + B * len(ids) / mean)
    return term.astype(np.int64), (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)


def strongest(ids: np.ndarray, idf: np.ndarray, mean: float, shared: np.ndarray) -> int:
    """The term with the largest weight among those that several documents have; the end id is always one."""
    term, weight = weights(ids, idf, mean)
    return int(term[np.where(shared[term], weight, -1).argmax()])


def dealt(rows: DataFrame, id_type: str, shared: Broadcast) -> DataFrame:
    """The rows (doc_id, ids) in ranges of their strongest terms, each sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, several = shared.value
        for batch in batches:
            keys = [strongest(np.frombuffer(t.as_buffer(), dtype=id_type), idf, mean, several) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int32())], names=["doc_id", "ids", "term"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = in_arrow(rows, run, f"doc_id {kind}, ids binary, term int").withColumn("place", F.xxhash64(F.col("doc_id").cast("string"), F.length("ids")))
    return keyed.repartitionByRange("term", "place").sortWithinPartitions("term", "place", "ids").select("doc_id", "ids")


class Index:
    """BM25 inverted index of one shard: postings by term, weights ready."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n = len(docs)
        terms, weight = zip(*(weights(ids, idf, mean) for ids in docs), strict=True)
        self.terms = terms
        owner = np.repeat(np.arange(self.n), [len(t) for t in terms])
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], np.concatenate(weight)[order]
        self.at = np.searchsorted(flat[order], np.arange(len(idf) + 1))

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term, by falling score for all terms of the document.

        They are sorted in blocks, each four times the one before, as far as the caller asks.
        """
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.terms[doc]]
        owners = np.concatenate([self.owner[s] for s in spans])
        scores = np.bincount(owners, np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        scores[~unused] = 0
        found = np.flatnonzero(scores)
        block = FIRST_BLOCK
        while len(found):
            least = -np.partition(-scores[found], min(block, len(found)) - 1)[min(block, len(found)) - 1]
            near = scores[found] >= least
            best, found = found[near], found[~near]
            yield from best[np.lexsort((best, -scores[best]))].tolist()
            block *= 4


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard; every window but the last is full."""
    pieces: list[tuple[int, int, int, int, int]] = []
    lengths = np.array([len(d) for d in docs])
    start = lengths // WINDOW * WINDOW  # whole windows of long documents need no neighbours
    sequence = 0
    for i in np.flatnonzero(start):
        for s in range(0, int(start[i]), WINDOW):
            pieces.append((int(i), s, WINDOW, sequence, 0))
            sequence += 1
    unused = start < lengths
    if not unused.any():
        return pieces
    index = Index(docs, idf, mean) if unused.sum() > 1 else None
    left = int((lengths - start).sum())
    cursor, room = 0, WINDOW
    last: list[tuple[int, int, int]] = []  # of the window that stays short

    def place(i: int) -> None:
        nonlocal left, room
        size = min(room, int(lengths[i] - start[i]))
        last.append((i, int(start[i]), size))
        start[i] += size
        left -= size
        room -= size
        unused[i] = start[i] < lengths[i]

    while left:
        while not unused[cursor]:
            cursor += 1
        room, last = WINDOW, []
        seed = cursor
        place(seed)
        if room and index and left > room:
            for i in index.neighbours(seed, unused):
                if unused[i]:
                    place(i)
                if not room:
                    break
        while room and left:
            while not unused[cursor]:
                cursor += 1
            place(cursor)
        if room == 0:
            offset = 0
            for i, s, size in last:
                pieces.append((i, s, size, sequence, offset))
                offset += size
            sequence += 1
    if room:
        short = WINDOW - room
        bits = [1 << k for k in range(WINDOW.bit_length() - 1, -1, -1) if short >> k & 1]
        parts = iter(last)
        i, s, size = next(parts)
        for length in bits:
            offset = 0
            while offset < length:
                if not size:
                    i, s, size = next(parts)
                take = min(size, length - offset)
                pieces.append((i, s, take, sequence, offset))
                offset, s, size = offset + take, s + take, size - take
            sequence += 1
    return pieces


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    with open(tokenizer_path) as f:
        text = f.read()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = _word_ids(hashlib.sha256(text.encode()).hexdigest(), text).size
    rows = tokenised(docs, text)
    n, mean, found = document_frequencies(rows, size)
    idf = np.log1p((n - found + 0.5) / (found + 0.5))
    shared = df.sparkSession.sparkContext.broadcast((idf, mean, found > 1))  # bounded by the vocabulary
    id_type = _id_type(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean, _ = shared.value
        base = TaskContext.get().partitionId() << 36
        held: list[np.ndarray] = []
        names: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held, names, size
            pieces = pack_shard(held, idf, mean)
            doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(held[d][s : s + k]) for d, s, k in zip(doc, start, length, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in doc], kind),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(np.array([len(h) for h in held], dtype=np.int64)[doc]),
                    pa.array(sequence + base),
                    pa.array(offset),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += int(sequence.max()) + 1
            held, names, size = [], [], 0
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, t in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(t.as_buffer(), dtype=id_type).astype("<u4")
                if held and size + len(own) > SHARD_TOKENS:
                    yield flush()
                held.append(own)
                names.append(doc_id.as_py())
                size += len(own)
        if held:
            yield flush()

    return in_arrow(dealt(rows.filter("ids IS NOT NULL").select("doc_id", "ids"), id_type, shared), run, _SCHEMA.format(df.schema[id_col].dataType.simpleString()))
