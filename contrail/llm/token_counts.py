"""Operator 10: token counts of a unigram vocabulary without making the tokens.

Texts are cut as a metaspace pre-tokenizer cuts them: spaces become ``\\u2581``, one is put before a text that
does not begin with it, and each starts a new pre-token. Within a pre-token an Aho-Corasick automaton lists
all vocabulary pieces that end at each place, and dynamic programming carries the best score and its number of
tokens. The tie rules are those of the ``tokenizers`` unigram model: the piece that begins first wins among
equal sums (64-bit floats), and a character without a piece of its own may be unknown at the lowest score less
10, coded as one token per UTF-8 byte where byte pieces exist, else one token for a run of unknowns.

Scores: the pieces and scores of the vocabulary file, whatever its own model type. Null text counts as empty: 0. An empty
table gives no rows. The dynamic programming holds as many places as the longest piece has characters, however long a pre-token is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens of up to so many characters are remembered by a Python worker; the store is emptied when full.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Normal pieces with scores in id order, and whether all 256 byte pieces exist, of a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in ids]
    pieces = [(p.id_to_piece(i), float(p.get_score(i))) for i in ids if not special[i]]
    return pieces, sum(p.is_byte(i) for i in ids) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_exist: bool) -> None:
        import ahocorasick

        self.bytes_exist = bytes_exist
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.longest = max((len(piece) for piece, _ in pieces), default=1)
        self.automaton.make_automaton()
        self.cache: dict[str, int] = {}

    def pre_token(self, text: str) -> int:
        size = self.longest + 1
        # the last ``size`` places: best score, pieces, whether the last one is unknown
        best, count, in_unknown = [0.0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(text) if len(self.automaton) else iter(())
        last, found = next(matches, (-1, None))
        for end in range(1, len(text) + 1):
            top, start_of, single = None, 0, False
            while last == end - 1:
                length, score = found
                start = end - length
                total = best[start % size] + score
                single |= length == 1
                if top is None or total > top or (total == top and start < start_of):
                    top, start_of = total, start
                last, found = next(matches, (-1, None))
            unknown = False
            before = (end - 1) % size
            if not single:
                total = best[before] + self.unknown
                if top is None or total > top:
                    top, start_of, unknown = total, end - 1, True
            at = end % size
            best[at] = top
            if not unknown:
                count[at] = count[start_of % size] + 1
            elif self.bytes_exist:
                count[at] = count[before] + len(text[end - 1].encode())
            else:
                count[at] = count[before] + (not in_unknown[before])
            in_unknown[at] = unknown
        return count[len(text) % size]

    def text(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        parts = text.split(MARK)
        parts = parts[1:] if text.startswith(MARK) else parts
        known, total = self.cache, 0
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.pre_token(MARK + part)
                if len(part) <= CACHE_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[part] = n
            total += n
        return total


_COUNTERS: dict[str, Counter] = {}


def count(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) per row; repeated rows are counted each."""
    pieces, bytes_exist = load_pieces(model_path)
    name = hashlib.sha256(repr((pieces, bytes_exist)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((pieces, bytes_exist))  # bounded by the vocabulary file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[name] = Counter(*shared.value)
        counter = _COUNTERS[name]
        for batch in batches:
            counts = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return in_arrow(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens long")
