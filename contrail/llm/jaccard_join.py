"""Operator 7: exact n-gram Jaccard join in a metric space.

A document is the set of its distinct five-word shingles (A-Z folded; 64-bit hashes). Documents with equal sets
are one *class*; everything below works on classes. Jaccard distance is a metric, and two classes link at
distance 0.2 or less.

*Regions.* Two documents without a common shingle are at distance 1, so most documents are at distance 1 from any
document one could choose as a pivot, and pivot distances alone cannot part them. The first level therefore takes
single shingles as pivots, in one global order. A document lies in the cell of its first shingle. Dropping the i
shingles before pivot s from a document of n moves it by distance i / n, so a partner of a document whose common
shingles begin at s lies within the window i <= 0.2 n, and each document is replicated to the pivots in its window and no
further. Every linked pair meets in the region of its first common shingle. The order puts shingles that many documents share last (a
fixed-size bitmap of counted hash buckets says which; it only affects the order, never the result), so a passage
that thousands of documents repeat does not bring them together.

*Inside a region* the member with the fewest shingles before the region's is the pivot, which of near copies is one of the least
edited; the others are compared with it. Members within
0.2 are linked and need no comparison among themselves, since only the group matters. In regions that stay large, members left outside
take another pivot, with a triangle-inequality window around the distances to the one before, and so on; when few stay apart they are compared
with all others of the region, each with its nearest by the signatures first, until nothing more joins. Nothing is capped: rounds only decide in
which order distances are measured, and pairs of one group need none.

*Distances* are measured on whole sets, and those are made from texts again: for each pair the text of one class travels to
the other class, which is sent once (a class with very many partners once for every ``SPOKES`` of them). Before that, 512 parity bits of each set
give a lower bound of the distance, which rules out most pairs and never a link.

A class has a 63-bit key and a second one of 64 bits; classes that share the first are told apart by the second.

Empty sets (null text or no word) link with nothing, also not with one another. Repeated rows stay rows of one class. Fewer
words than five count as one shingle of the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .shared import discard, in_arrow, stored
from .textvec import Block, blocks, mix, per_text, range_hash, windows

SHINGLE = 5
#: Similarity as a fraction of whole numbers: NUM / DEN.
NUM, DEN = 4, 5
#: Hash buckets for counting shingles, as a power of two; a bitmap of them is sent to all workers (8 MB).
BUCKET_BITS = 26
#: Hash buckets of the ids whose texts are wanted, as a power of two (2 MB).
PICK_BITS = 24
#: A shingle is common when its bucket holds so many, plus twice the mean.
COMMON = 32
#: Regions with more members take further pivots, as long as that shrinks them, before the signatures of members are compared in pairs.
LARGE_REGION = 512
PIVOT_ROUNDS = 6
#: Classes that a task remembers having sent, so that copies are sent once; the store is emptied when full.
REMEMBERED = 200_000
#: Shingles whose buckets a task holds before it counts them.
HELD = 400_000
#: Partners of a class that are measured before the others are looked at again.
NEAREST = 2
#: Partners of a class that one group compares with it.
SPOKES = 500
SIGNATURE = [f"s{k}" for k in range(8)]
_U64 = np.uint64


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and their offsets."""
    n = block.n
    starts, ends, owner = block.word_spans()
    words = block.span_hash(starts, ends, fold=True)
    grams, first = windows(words, owner, SHINGLE)
    owners = owner[first]
    counts = per_text(owner, n)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        at = np.concatenate([[0], np.cumsum(counts)])
        grams = np.concatenate([grams, range_hash(words, at[short], at[short] + counts[short])])
        owners = np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    if len(grams):
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
        grams, owners = grams[new], owners[new]
    return grams, np.concatenate([[0], np.cumsum(per_text(owners, n))])


def _class_keys(grams: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each set, of 63 and 64 bits; the first is 0 for the empty set."""
    sizes = np.diff(off)

    def summed(times: int, add: int) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams * _U64(times) + _U64(add)))])
        return mix(sums[off[1:]] - sums[off[:-1]] + sizes.astype(np.uint64) * _U64(0xA0761D6478BD642F))

    first = np.where(sizes > 0, summed(0x9FB21C651E98DF25, 1) | _U64(1), _U64(0))
    return first.view(np.int64), summed(0xC2B2AE3D27D4EB4F, 7).view(np.int64)


def _signatures(grams: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """512 parity bits of each set: two sets differ in at least as many shingles as in bits."""
    full = np.flatnonzero(np.diff(off))
    word, bit = (grams >> _U64(61)).astype(np.int8), _U64(1) << (grams >> _U64(55) & _U64(63))
    out = []
    for k in range(len(SIGNATURE)):
        bits = np.zeros(len(off) - 1, dtype=np.uint64)
        if len(full):
            bits[full] = np.bitwise_xor.reduceat(np.where(word == k, bit, _U64(0)), off[:-1][full])
        out.append(bits.view(np.int64))
    return out


def _prefix_sizes(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pivots in each document's window: positions 0 .. n - ceil(num / den * n)."""
    return np.where(sizes > 0, sizes - (num * sizes + den - 1) // den + 1, 0)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of all ranges."""
    total = int(lengths.sum())
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return base + np.arange(total)


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts. Rows (doc_id, n_shingles, cls, cls2, signature) for the documents, and rows (part, counts) that count,
    in compact form, the hash buckets of the shingles that may become pivots, with half as many to spare."""
    numbers = ["n_shingles", "cls", "cls2", *SIGNATURE]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            part, cut = np.unique(bucket >> 16, return_index=True)
            low, times = (bucket & 0xFFFF).astype("<u2"), np.minimum(times, 255).astype(np.uint8)
            ends = [*cut[1:], len(bucket)] if len(cut) else []
            packed = [low[i:j].tobytes() + times[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
            none = len(part)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.nulls(none, kind), *(pa.nulls(none, pa.int64()) for _ in numbers), pa.array(part.astype(np.int32)), pa.array(packed, pa.binary())],
                names=names,
            )

        names, kind = ["doc_id", *numbers, "part", "counts"], pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for block in blocks(batch.column(1)):
                grams, off = shingle_sets(block)
                sizes = np.diff(off)
                some = np.minimum(sizes, _prefix_sizes(sizes, NUM, DEN) * 3 // 2)
                held.append((grams[_ragged(off[:-1], some)] & _U64((1 << BUCKET_BITS) - 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n),
                        *map(pa.array, (sizes, *_class_keys(grams, off), *_signatures(grams, off))),
                        pa.nulls(block.n, pa.int32()),
                        pa.nulls(block.n, pa.binary()),
                    ],
                    names=names,
                )
                if sum(map(len, held)) > HELD:
                    yield counted()
        if held:
            yield counted()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs, run, f"doc_id {kind}, {', '.join(f'{x} long' for x in numbers)}, part int, counts binary")


def _common(rows: DataFrame, counts: DataFrame) -> np.ndarray:
    """Bitmap of the buckets that hold many shingles, from the (part, counts) rows; its size is fixed, and a task counts one part at a time."""
    window = F.col("n_shingles") - F.ceil(F.col("n_shingles") * NUM / DEN) + 1
    counted = rows.filter("n_shingles > 0").agg(F.sum(F.least("n_shingles", F.floor(window * 3 / 2)))).first()[0] or 0
    least = COMMON + 2 * counted / (1 << BUCKET_BITS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(1 << 16, np.int32), None

        def marks() -> pa.RecordBatch:
            bits = np.packbits(total > least, bitorder="little").tobytes()
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at is not None and part != at:
                    yield marks()
                at, raw = part, packed.as_buffer()
                n = len(raw) // 3
                total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, np.uint8, n, 2 * n)
        if at is not None:
            yield marks()

    out = np.zeros(1 << (BUCKET_BITS - 3), dtype=np.uint8)
    sorted_ = counts.repartition("part").sortWithinPartitions("part")
    for row in in_arrow(sorted_, run, "part int, bits binary").collect():  # 2 ** (BUCKET_BITS - 3) bytes in all
        out[row["part"] << 13 : (row["part"] + 1) << 13] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _has_bit(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _regions(docs: DataFrame, common: Broadcast, clashes: list[int]) -> DataFrame:
    """(pivot, cls, n, pos): every class in the regions of its window, by the global order (common, hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = common.value
        sent: set[int] = {0}
        for batch in batches:
            for block in blocks(batch.column(1)):
                grams, off = shingle_sets(block)
                keys, sizes = _resolved(*_class_keys(grams, off), clashes), np.diff(off)
                new = [k not in sent and not sent.add(k) for k in keys.tolist()]
                if len(sent) > REMEMBERED:
                    sent = {0}
                shared = _has_bit(bitmap, grams & _U64((1 << BUCKET_BITS) - 1))
                owner = np.repeat(np.arange(block.n), sizes)
                grams = grams[np.lexsort((grams, shared, owner))]
                window = np.where(new, _prefix_sizes(sizes, NUM, DEN), 0)
                at = _ragged(off[:-1], window)
                own = np.repeat(np.arange(block.n), window)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[at].view(np.int64)),
                        pa.array(keys[own]),
                        pa.array(sizes[own].astype(np.int32)),
                        pa.array((at - off[:-1][own]).astype(np.int32)),
                    ],
                    names=["pivot", "cls", "n", "pos"],
                )

    return in_arrow(docs.select("doc_id", "text"), run, "pivot long, cls long, n int, pos int")


def _resolved(first: np.ndarray, second: np.ndarray, clashes: list[int]) -> np.ndarray:
    """The first keys; where classes share one, the second."""
    return np.where(np.isin(first, clashes), second, first) if clashes else first


def _reach(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets of these sizes whose common shingles begin at these positions can be similar enough."""
    return (NUM + DEN) * (1 + F.least(n1 - p1 - 1, n2 - p2 - 1)) >= NUM * (n1 + n2)


def _meetings(regions: DataFrame) -> DataFrame:
    """Rows of regions with at least two classes, each with its region's pivot document ``lead``: the one with the fewest shingles before the region's.

    Rare shingles come first, so of near copies that is one of the least edited, which most others link with.
    Streams over sorted rows; a region is never held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, while it is not known whether others follow
        lead: tuple | None = None
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            pivot = whole.column(0).to_numpy()
            cls, n, pos = (whole.column(k).to_numpy() for k in (1, 2, 3))
            new = np.ones(len(pivot), dtype=bool)
            new[1:] = (pivot[1:] != pivot[:-1]) | (cls[1:] != cls[:-1])
            new[0] = last != (pivot[0], cls[0])
            if held is not None:
                new[0] = True
            last = (pivot[-1], cls[-1])
            if not new.all():  # copies that came from different tasks
                whole = whole.filter(pa.array(new))
                pivot, cls, n, pos = pivot[new], cls[new], n[new], pos[new]
                if not len(pivot):
                    continue
            first = np.ones(len(pivot), dtype=bool)
            first[1:] = pivot[1:] != pivot[:-1]
            if lead is not None and pivot[0] == lead[0]:
                first[0] = held is not None
            starts = np.maximum.accumulate(np.where(first, np.arange(len(pivot)), -1))
            lead_of = [np.where(starts >= 0, x[np.maximum(starts, 0)], y) for x, y in zip((cls, n, pos), lead[1:] if lead else (0, 0, 0), strict=True)]
            alone = first.copy()
            alone[:-1] &= first[1:]
            lead = (pivot[-1], *(x[-1] for x in lead_of))
            keep = ~alone
            if alone[-1]:
                held = whole.slice(len(pivot) - 1)
                keep[-1] = False
            else:
                held = None
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [*(whole.column(k).take(pa.array(at)) for k in range(4)), *(pa.array(x[at]) for x in lead_of)],
                    names=["pivot", "cls", "n", "pos", "lead", "lead_n", "lead_pos"],
                )

    return in_arrow(
        regions.repartition("pivot").sortWithinPartitions("pivot", "pos", "cls"),
        run,
        "pivot long, cls long, n int, pos int, lead long, lead_n int, lead_pos int",
    )


def _texts(docs: DataFrame, classes: DataFrame, needed: DataFrame, clashes: list[int]) -> DataFrame:
    """(cls, text) of the needed classes, from each class's first document.

    A fixed-size bitmap of hashed ids spares the other documents; the join makes it exact.
    """
    first = stored(classes.join(needed, "cls", "left_semi").filter("least IS NOT NULL").select("cls", F.col("least").alias("doc_id")), "needed")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << PICK_BITS)).cast("int")
    words = first.select(place.alias("at")).groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("v"))
    marks = np.zeros(1 << (PICK_BITS - 5), dtype="<u4")
    pdf = words.toPandas()  # 2 ** (PICK_BITS - 5) rows at most
    marks[pdf["w"].to_numpy(np.int64)] = pdf["v"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(marks.view(np.uint8))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(_has_bit(shared.value, at))
            if not len(mine):
                continue
            part = batch.take(pa.array(mine))
            for block in blocks(part.column(1)):
                rows = part.slice(block.first, block.n)
                keys = _resolved(*_class_keys(*shingle_sets(block)), clashes)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys), rows.column(1)], names=["doc_id", "cls", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = in_arrow(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", place.alias("at")), run, f"doc_id {kind}, cls long, text string")
    return stored(made.join(first, ["doc_id", "cls"], "left_semi").dropDuplicates(["doc_id", "cls"]).select("cls", "text"), "texts")


def _apart(x: str, y: str) -> Column:
    """Bits in which the signatures of two sets differ."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in SIGNATURE), F.lit(0))


def _plausible(x: str, y: str) -> Column:
    """Whether the signatures of two sets leave room for a link: n1 + n2 >= 9 times the shingles that only one of them has."""
    return (DEN + NUM) * _apart(x, y) <= (DEN - NUM) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _signed_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (spoke, hub) that the signatures do not rule out."""
    signed = classes.select("cls", "n", *SIGNATURE)
    met = pairs.join(signed.alias("x"), F.col("spoke") == F.col("x.cls")).join(signed.alias("y"), (F.col("hub") == F.col("y.cls")) & _plausible("x", "y"))
    return met.select("spoke", "hub")


def _measured(pairs: DataFrame, docs: DataFrame, classes: DataFrame, clashes: list[int]) -> DataFrame:
    """(spoke, hub, d, linked) of the distinct pairs (spoke, hub), exactly; a pair that is ruled out has no row."""
    pairs = stored(_signed_pairs(pairs, classes), "pairs")
    texts = _texts(docs, classes, pairs.select(F.explode(F.array("spoke", "hub")).alias("cls")).distinct(), clashes)
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("k")).filter(F.col("k") > SPOKES)
    share = F.ceil(F.coalesce("k", F.lit(1)) / SPOKES)
    salted = pairs.join(sizes, "hub", "left").select("spoke", "hub", F.pmod(F.xxhash64("spoke"), share).cast("int").alias("part"))
    spokes = salted.join(texts.withColumnRenamed("cls", "spoke"), "spoke").select("hub", "part", "spoke", "text")
    hubs = salted.select("hub", "part").distinct().join(texts.withColumnRenamed("cls", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("spoke"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, dtype=np.uint64)  # the set of the hub whose spokes follow
        for batch in batches:
            for block in blocks(batch.column(2)):
                rows = batch.slice(block.first, block.n)
                grams, off = shingle_sets(block)
                common, either = np.zeros(block.n, np.int64), np.ones(block.n, np.int64)
                is_hub = rows.column(1).is_null().to_numpy(zero_copy_only=False)
                for k in range(block.n):
                    own = grams[off[k] : off[k + 1]]
                    if is_hub[k]:
                        held = own.copy()
                        continue
                    at = np.searchsorted(held, own)
                    common[k] = np.count_nonzero(held[np.minimum(at, len(held) - 1)] == own)
                    either[k] = len(held) + len(own) - common[k]
                keep = pa.array(~is_hub)
                out = [rows.column(1), rows.column(0), pa.array(1 - common / either), pa.array(DEN * common >= NUM * either)]
                yield pa.RecordBatch.from_arrays([x.filter(keep) for x in out], names=["spoke", "hub", "d", "linked"])

    met = hubs.unionByName(spokes).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("spoke").asc_nulls_first())
    out = stored(in_arrow(met.select("hub", "spoke", "text"), run, "spoke long, hub long, d double, linked boolean"), "distances")
    discard(texts, pairs)
    return out


def _thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same classes as links (spoke, hub): each spoke keeps its smallest hub, to which its other hubs are linked.

    Near copies meet in many regions and have a hub in each of them; the hubs are few, and so are the links between them that differ.
    """
    least = F.min("hub").over(W.partitionBy("spoke"))
    kept = links.select("spoke", "hub", least.alias("b")).select(F.when(F.col("hub") == F.col("b"), F.col("spoke")).otherwise(F.col("hub")).alias("a"), "b")
    return kept.distinct()


def _groups(done: DataFrame) -> DataFrame:
    return components(_thinned(done.filter("linked"))).withColumnRenamed("node", "cls")


def _open(member: DataFrame, groups: DataFrame) -> DataFrame:
    """Region members with their group and the region's size; only regions that still hold more than one group."""
    named = member.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    sizes = named.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo != hi")
    return stored(named.join(sizes.select("pivot", "size"), "pivot"), "open")


def group_links(docs: DataFrame, classes: DataFrame, common: np.ndarray, clashes: list[int]) -> DataFrame:
    """Links (a, b) between classes that connect exactly the classes connected by similarity."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    meet = stored(_meetings(_regions(docs, shared, clashes)), "meet")
    shared.unpersist()
    reach = _reach(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"))
    pairs = meet.filter(F.col("cls") != F.col("lead")).filter(reach).select(F.col("cls").alias("spoke"), F.col("lead").alias("hub")).distinct()
    done = _measured(pairs, docs, classes, clashes)
    # the pivot itself is finished
    left = _open(meet.filter("cls != lead").select("pivot", "cls", "n", "pos"), _groups(done)).withColumn("d", F.lit(None).cast("double"))
    discard(meet)
    small, large = left.filter(F.col("size") <= LARGE_REGION), left.filter(F.col("size") > LARGE_REGION)
    before = 0
    for _ in range(PIVOT_ROUNDS):
        members = large.count()
        if not members or 0 < 0.9 * before < members:
            break
        before = members
        lead = stored(_next_pivots(large), "leads")
        near = _window(F.col("d"), F.col("lead_d")) & _reach(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos"))
        pairs = large.join(lead, "pivot").filter((F.col("comp") != F.col("lead_comp")) & near).select(F.col("cls").alias("spoke"), F.col("lead").alias("hub"))
        new = _measured(_unmeasured(pairs.distinct(), done), docs, classes, clashes)
        done = done.unionByName(new)
        outside = (
            large.drop("comp", "size", "d")
            .join(lead.select("pivot", "lead"), "pivot")
            .filter("cls != lead")
            .join(new.select(F.col("spoke").alias("cls"), F.col("hub").alias("lead"), "d"), ["cls", "lead"], "left")
        )
        left = _open(outside.drop("lead"), _groups(done))
        small, large = small.unionByName(left.filter(F.col("size") <= LARGE_REGION)), left.filter(F.col("size") > LARGE_REGION)
    # members of a region's main group are connected already; all others meet everyone in their window
    left = small.unionByName(large)
    size = left.groupBy("pivot", "comp").agg(F.count("*").alias("size"))
    main = size.groupBy("pivot").agg(F.max(F.struct("size", "comp")).alias("m")).select("pivot", F.col("m.comp").alias("main"))
    left = stored(left.join(classes.select("cls", *SIGNATURE), "cls").join(main, "pivot"), "left")
    pairs = _unmeasured(_region_pairs(left.filter("comp != main"), left, F.col("x.comp") != F.col("y.comp")), done)
    return _thinned(_nearest_first(pairs, done, docs, classes, clashes).filter("linked"))


def _nearest_first(pairs: DataFrame, done: DataFrame, docs: DataFrame, classes: DataFrame, clashes: list[int]) -> DataFrame:
    """``done`` with the distances of ``pairs`` (spoke, hub, apart), but for pairs that others have brought into one group by then.

    Each class meets its nearest by the signatures first. As soon as that leaves more than half of the pairs, all of them are measured.
    """
    by = {side: F.row_number().over(W.partitionBy(side).orderBy("apart", "spoke", "hub")) for side in ("spoke", "hub")}
    before = 0
    while True:
        ranked = stored(pairs.select("spoke", "hub", "apart", F.least(*by.values()).alias("rank")), "ranked")
        every, some = (int(x or 0) for x in ranked.agg(F.count("*"), F.count_if(F.col("rank") <= NEAREST)).first())
        last = 2 * some > every or 0 < before < 2 * every
        if every:
            done = done.unionByName(_measured(ranked if last else ranked.filter(F.col("rank") <= NEAREST), docs, classes, clashes))
        if last or not every:
            discard(ranked)
            return done
        before = every
        groups = _groups(done)
        spoke, hub = (groups.select(F.col("cls").alias(side), F.col("comp").alias(f"{side}_comp")) for side in ("spoke", "hub"))
        named = ranked.filter(F.col("rank") > NEAREST).join(spoke, "spoke", "left").join(hub, "hub", "left")
        pairs = named.filter(F.coalesce("spoke_comp", "spoke") != F.coalesce("hub_comp", "hub"))


def _region_pairs(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
    """Pairs (spoke, hub) that meet in a region, and how far their signatures are apart as a share of both sizes."""
    x, y = left.alias("x"), right.alias("y")
    near = _window(F.col("x.d"), F.col("y.d")) & _reach(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & extra & near & _plausible("x", "y"))
    apart = _apart("x", "y") / (F.col("x.n") + F.col("y.n"))
    return met.select(F.greatest("x.cls", "y.cls").alias("spoke"), F.least("x.cls", "y.cls").alias("hub"), apart.alias("apart")).distinct()


def _unmeasured(pairs: DataFrame, done: DataFrame) -> DataFrame:
    both = done.select(F.explode(F.array(F.struct("spoke", "hub"), F.struct(F.col("hub").alias("spoke"), F.col("spoke").alias("hub")))).alias("p")).select("p.*")
    return pairs.join(both, ["spoke", "hub"], "left_anti")


def _next_pivots(crowded: DataFrame) -> DataFrame:
    """For each region the member with the fewest shingles before the region's, as lead_comp, lead, lead_n, lead_pos and lead_d."""
    p = crowded.groupBy("pivot").agg(F.min(F.struct("pos", "cls", "n", "d", "comp")).alias("p"))
    return p.select("pivot", *(F.col(f"p.{a}").alias(b) for a, b in (("comp", "lead_comp"), ("cls", "lead"), ("n", "lead_n"), ("pos", "lead_pos"), ("d", "lead_d"))))


def _window(d1: Column, d2: Column) -> Column:
    """Triangle inequality: two members can be within 1 - NUM / DEN only if so are their distances to a pivot."""
    return F.coalesce(F.abs(d1 - d2) <= (1 - NUM / DEN) + 1e-9, F.lit(True))


def _prepared(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray, list[int]]:
    """Documents, their rows (doc_id, n_shingles, cls), the classes, the common buckets and the first keys that classes share."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = stored(_scan(docs), "scan")
    rows = seen.filter("part IS NULL").drop("part", "counts")

    def classes() -> DataFrame:
        merged = rows.filter("cls != 0").groupBy("cls").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in SIGNATURE), F.min("cls2").alias("lo"), F.max("cls2").alias("hi")
        )
        return stored(merged, "classes")

    made = classes()
    clashes = [r.cls for r in made.filter("lo != hi").select("cls").collect()]  # about n * n / 2 ** 64 of n classes
    if clashes:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(clashes), F.col("cls2")).otherwise(F.col("cls")))
        made = classes()
    return docs, rows.select("doc_id", "n_shingles", "cls"), made, _common(rows, seen.filter("part IS NOT NULL").select("part", "counts")), clashes


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest id reachable by links, itself included.

    Only groups are found, not the links within them; ``links`` has those. A row without an id keeps its class's group but
    connects nothing by itself. The input is read several times and must give the same rows each time.
    """
    docs, rows, classes, common, clashes = _prepared(df, id_col, text_col)
    groups = components(group_links(docs, classes, common, clashes)).withColumnRenamed("node", "cls")
    named = stored(classes.select("cls", "least").join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "named")
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(ids, "comp").select("cls", "component_id")
    return rows.join(by_class, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the membership: (a, b, d) of classes, each named by its smallest id, and
    (doc_id, class_id) per row with a set. A group of g different near copies has up to g * g / 2 links, and all are given."""
    docs, rows, classes, common, clashes = _prepared(df, id_col, text_col)
    meet = stored(_meetings(_regions(docs, docs.sparkSession.sparkContext.broadcast(common), clashes)), "meet")
    member = meet.select("pivot", "cls", "n", "pos", F.lit(None).cast("double").alias("d")).join(classes.select("cls", *SIGNATURE), "cls")
    done = _measured(_region_pairs(member, member, F.col("x.cls") > F.col("y.cls")), docs, classes, clashes)
    name = classes.select("cls", F.col("least").alias("class_id"))
    a, b = (name.select(F.col("cls").alias(side), F.col("class_id").alias(as_)) for side, as_ in (("spoke", "p"), ("hub", "q")))
    found = done.filter("linked").join(a, "spoke").join(b, "hub").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "d")
    return found, rows.join(name, "cls").select("doc_id", "class_id")


def apply(df: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    gone = join(df).filter("component_id != doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*df.columns)
