"""Operator 5: line de-duplication by a segment-partition edit join (DataFrame functions only).

Equal lines are merged first, so the join runs over distinct lines. Two distinct lines link when their edit distance is at
most ``edits`` and at most one for every ``chars_per_edit`` code points of the shorter line; so lines of fewer than that
match only when equal. With ``chars_per_edit`` 0 the threshold is the same for all lines. A line of length l is split into EDITS + 1 even segments; a partner must contain
one of them unchanged, near its place. The index holds (l, segment number, segment) of every line; every line probes the lengths n - EDITS .. n
with the substrings that the length difference and the segment number still allow.

Lines move as numbers: a 64-bit id and a second key of 64 bits (lines that share the first are told apart by the second), lengths, segment hashes, and
a 56-bit signature of the words, which rules out most pairs without ever ruling out a link. A bitmap of the segment hashes, of fixed size, is
sent to all machines, so that only probes that may meet another line are shuffled. Texts are read again for the lines that
are left in pairs; with segments that more than ``LARGE_BUCKET`` lines have they travel with the keys, in parts of some ``PART`` lines, and the pairs are tested inside
the join, which puts out links only. The test is a banded bit-parallel computation of the distance, between the common beginning and end of both lines.

Lines are split at ``\\n``; a line without a word (white space ``\\x20\\x09-\\x0D`` only) is not a line here. Null and empty
texts have none; an empty table gives no rows. Rows with the same id are told apart by ``row``. A class is a group of lines connected by equality
and links; its first line has the smallest (doc_id, line_no). The input is read three times and must give the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

EDITS = 2
CHARS_PER_EDIT = 10
#: Texts travel with the keys of segments that more lines have, so that the join puts out links only.
LARGE_BUCKET = 16
#: Lines of a crowded segment that one part of its join holds.
PART = 64
#: Characters over which the distance of two lines is reckoned before they are split whole.
FIRST_COLUMNS = 32
#: Bits of a bitmap of hashes, as a power of two (16 MB, of which index_words() takes nearly all), and 64-bit words in one row of it.
INDEX_BITS = 27
CHUNK_WORDS = 1 << 11
SPACES = " \t\n\x0b\x0c\r"


def allowed(shorter: Column, edits: int, chars_per_edit: int) -> Column:
    """Edits between lines of which the shorter has so many code points; without ``chars_per_edit`` the plain threshold."""
    return F.least(F.lit(edits), F.floor(shorter / chars_per_edit)) if chars_per_edit else F.lit(edits)


def segment(length: Column, k: int, edits: int) -> tuple[Column, Column]:
    """1-based start and size of segment k (from 0) of a line of this length: even, the longer ones last."""
    base, rest = F.floor(length / (edits + 1)), length % (edits + 1)
    plain = (edits + 1) - rest  # segments of the base size
    start = k * base + F.greatest(F.lit(0), k - plain) + 1
    return start.cast("int"), (base + (F.lit(k) >= plain).cast("int")).cast("int")


def _key(length: Column, k: int, line: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(k), F.substring(line, start, size))


def index_keys(line: Column, n: Column, edits: int) -> Column:
    keys = []
    for k in range(edits + 1):
        start, size = segment(n, k, edits)
        keys.append(_key(n, k, line, start, size))
    return F.array(*keys)


def with_probes(lines: DataFrame, edits: int) -> DataFrame:
    """Rows (id, line, n) with ``seg``: of all lengths n - edits .. n the substrings that can be a partner's segment, counted from both ends,
    without the line's own segments. One small expression for a row of each kind of probe."""
    kinds = []
    for less in range(edits + 1):
        for k in range(edits + 1):
            for shift in range(max(-k, less - (edits - k)), min(k, less + (edits - k)) + 1):
                if less or shift:
                    kinds.append(F.struct(F.lit(less).alias("less"), F.lit(k).alias("k"), F.lit(shift).alias("shift")))
    if not kinds:
        return lines.select("id", "line", "n", F.lit(0).cast("long").alias("seg")).limit(0)
    asked = lines.withColumn("c", F.explode(F.array(*kinds))).select("id", "line", "n", (F.col("n") - F.col("c.less")).alias("m"), "c.k", "c.shift")
    base, plain = F.expr(f"CAST(m DIV {edits + 1} AS INT)"), (edits + 1) - F.col("m") % (edits + 1)
    placed = asked.select("id", "line", "n", "m", "k", (F.col("k") * base + F.greatest(F.lit(0), F.col("k") - plain) + 1 + F.col("shift")).alias("at"), (base + (F.col("k") >= plain).cast("int")).alias("size"))
    seg = F.xxhash64(F.col("m"), F.col("k"), F.substring(F.col("line"), F.col("at"), F.col("size")))
    return placed.filter("m >= 1 AND at >= 1").select("id", "line", "n", seg.alias("seg"))


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance by Hyyro's banded bit-parallel recurrence on 2 * most + 1 diagonals; above most: more than most.

    a and b are arrays of characters, not empty, whose sizes differ by at most ``most``. Once the value on the lowest diagonal is above 3 * most, every
    other in the band is above most and stays there, so the rest of b is passed over.
    """
    top = 2 * most
    mask = (1 << (top + 1)) - 1
    long = lambda x: F.lit(x).cast("long")
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluates x once
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(long(1))
    last = F.size(a) - most

    def matches(at: Column, i: Column) -> Column:
        """Bit r: whether a[i + r - most] is this character of b."""
        out = long(0)
        for r in range(top + 1):
            k = i + (r - most)
            out = out.bitwiseOR(F.when((k >= 0) & (F.get(a, F.greatest(k, F.lit(0))) == at), long(1 << r)).otherwise(long(0)))
        return out

    def step(s: Column, at: Column) -> Column:
        work = bound(matches(at, s["i"]), lambda match: diagonal(s, match))
        return F.when(s["dist"] > 3 * most, s).otherwise(work)

    def diagonal(s: Column, match: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        d0 = ((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(long(mask))
        return bound(d0, lambda d0: moved(s, d0))

    def moved(s: Column, d0: Column) -> Column:
        vp, vn, i = s["vp"], s["vn"], s["i"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(long(mask))
        hn = d0.bitwiseAND(vp)
        # beyond the last full diagonal the distance moves along the last row
        row = F.greatest(F.lit(0), top - 1 - (i - last)).cast("int")
        dist = s["dist"] + F.when(i < last, 1 - bit(d0, F.lit(top))).otherwise(bit(hp, row) - bit(hn, row))
        right = F.shiftright(d0, 1)
        return F.struct(
            (i + 1).alias("i"),
            hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp))).bitwiseAND(long(mask)).alias("vp"),
            right.bitwiseAND(hp).alias("vn"),
            dist.alias("dist"),
        )

    start = F.struct(F.lit(0).alias("i"), long(mask >> most << most).alias("vp"), long(0).alias("vn"), F.least(F.lit(most), F.size(a)).cast("long").alias("dist"))
    return F.aggregate(b, start, step, lambda s: s["dist"])


def _common(x: Column, y: Column, n: Column, first: bool) -> Column:
    """How many of the first (last) n code points of x and y are equal: halving steps of a native comparison."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    part = lambda s, at, size: F.substring(s, at + 1, size) if first else F.substring(s, F.char_length(s) - at - size + 1, size)
    return F.aggregate(steps, F.lit(0), lambda at, size: F.when((at + size <= n) & (part(x, at, size) == part(y, at, size)), at + size).otherwise(at))


def within(x: Column, y: Column, edits: int, chars_per_edit: int) -> Column:
    """Whether two lines, whose lengths differ by at most ``edits``, link. What lies between their common beginning and their common end decides."""
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    shorter = F.least(F.char_length(x), F.char_length(y))

    def ends(at: Column) -> Column:
        rest = lambda s: F.substring(s, at["head"] + 1, F.char_length(s) - at["head"] - at["tail"])
        return bound(F.struct(rest(x).alias("x"), rest(y).alias("y")), lambda r: distance(r["x"], r["y"]))

    def distance(a: Column, b: Column) -> Column:
        longer = F.greatest(F.char_length(a), F.char_length(b)).cast("long")
        reckoned = lambda a, b: banded_distance(F.split(a, ""), F.split(b, ""), edits) if edits else longer
        # most pairs fall apart in the first columns: those need no more of a than the band reaches, and above 3 * edits the rest changes nothing
        begun = F.when(F.char_length(b) > FIRST_COLUMNS + edits, reckoned(F.substring(a, 1, FIRST_COLUMNS + 2 * edits), F.substring(b, 1, FIRST_COLUMNS))).otherwise(F.lit(0).cast("long"))
        whole = bound(begun, lambda d: F.when(d > 3 * edits, d).otherwise(reckoned(a, b)))
        return F.when((F.char_length(a) == 0) | (F.char_length(b) == 0), longer).otherwise(whole)

    def distance_of_ends(a: Column, b: Column) -> Column:
        """For up to two edits. First and last characters differ, so an edit stands at either end, and what lies between must be equal."""
        na, nb = F.char_length(a), F.char_length(b)
        cut = lambda s, n, first, last: F.substring(s, first + 1, n - first - last)
        equal = lambda first, last: cut(a, na, first[0], last[0]) == cut(b, nb, first[1], last[1])
        both, of_a, of_b = (1, 1), (1, 0), (0, 1)  # characters that an edit takes from a and b
        ends = (
            F.when(na - nb == 0, equal(both, both) | equal(of_a, of_b) | equal(of_b, of_a))
            .when(na - nb == 1, equal(both, of_a) | equal(of_a, both))
            .when(na - nb == -1, equal(both, of_b) | equal(of_b, both))
            .when(na - nb == 2, equal(of_a, of_a))
            .otherwise(equal(of_b, of_b))
        )
        longer = F.greatest(na, nb)
        return F.when((na == 0) | (nb == 0) | (longer <= 1), longer).when(ends, 2).otherwise(3)

    if edits <= 2:
        distance = distance_of_ends
    head = bound(_common(x, y, shorter, True), lambda h: F.struct(h.alias("head"), _common(x, y, shorter - h, False).alias("tail")))
    return bound(head, ends) <= allowed(shorter, edits, chars_per_edit)


def index_words() -> int:
    """64-bit words of a bitmap: 31 / 32 of the power of two. With what its rows need besides it then stays below that power; a broadcast
    table of rows grows by doubling, so a few bytes more would take twice the memory of the driver and of each executor.
    """
    return max(1, (1 << (INDEX_BITS - 6)) // CHUNK_WORDS * 31 // 32) * CHUNK_WORDS


def _place(key: Column) -> tuple[Column, Column]:
    """Word of a bitmap, and the three bits in it, that stand for a hash; they come from different bits of the hash."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(key, by).bitwiseAND(63).cast("int")) for by in (40, 46, 52)]
    return F.pmod(key, F.lit(index_words())), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def bitmap(keys: DataFrame, **flags: Column) -> DataFrame:
    """(chunk, a bit array for each flag) of the hashes ``key``: nearly 2 ** INDEX_BITS bits each, in rows of CHUNK_WORDS longs.

    Three bits of one word stand for a hash, so that others pass with the third power of what is set, not in proportion to it.
    """
    at, bit = _place(F.col("key"))
    none = F.lit(0).cast("long")
    words = keys.select(at.alias("w"), *(F.when(c, bit).otherwise(none).alias(f) for f, c in flags.items()))
    zero = keys.sparkSession.range(index_words()).select(F.col("id").alias("w"), *(none.alias(f) for f in flags))
    full = words.unionByName(zero).groupBy("w").agg(*(F.bit_or(f).alias(f) for f in flags))
    chunks = full.groupBy(F.floor(F.col("w") / CHUNK_WORDS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("w", *flags))).alias("words"))
    return chunks.select("chunk", *(F.col(f"words.{f}").alias(f) for f in flags))


def marked(df: DataFrame, key: str, bits: DataFrame, flag: Column) -> DataFrame:
    """The rows of df whose key is marked; ``flag`` is a bit array of bits."""
    at, bit = _place(F.col(key))
    met = df.withColumn("chunk", F.floor(at / CHUNK_WORDS)).join(F.broadcast(bits), "chunk")
    word = F.get(flag, F.pmod(at, F.lit(CHUNK_WORDS)).cast("int"))
    return met.filter(F.bitwise_not(word).bitwiseAND(bit) == 0).drop("chunk", *(c for c in bits.columns if c != "chunk"))


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, line_no, line, n) of all lines with a word; n counts code points."""
    return (
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("doc_id"),
            F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"),
        )
        .filter(~F.substring("line", 1, 1).isin("", *SPACES) | (F.length(F.btrim("line", F.lit(SPACES))) > 0))
        .withColumn("n", F.char_length("line"))
    )


def parts(line: Column) -> Column:
    """What stands between the single spaces of a line: its words, and empty strings where there are more."""
    return F.split(line, " ", -1)


def n_words(line: Column, between: Column | None = None) -> Column:
    """Words of a line, of which ``between`` may have the parts already: those, or by the pattern where there is other white space."""
    between = parts(line) if between is None else between
    odd = F.lit(False)
    for gap in ("\t", "\x0b", "\x0c", "\r"):
        odd = odd | line.contains(gap)
    return F.when(odd, F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))).otherwise(F.size(F.array_remove(between, "")))


def line_keys(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def line_id(clashes: list[int]) -> Column:
    """The first key of a line, or the second where distinct lines share the first."""
    first, second = line_keys(F.col("line"))
    return F.when(first.isin(clashes), second).otherwise(first) if clashes else first


def signature(between: Column) -> Column:
    """A long: 56 parity bits of the hashed words (parts between single spaces).

    One edit changes at most three words, added and removed, so lines within so many edits differ in at most three
    times as many parity bits.
    """
    one = F.lit(1).cast("long")
    bit = lambda w: F.call_function("shiftleft", one, F.pmod(F.xxhash64(w), F.lit(56)).cast("int"))
    parity = F.aggregate(between, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w)))
    return parity


def links(distinct: DataFrame, lines: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(a, b) with a < b of the linked rows of distinct (id, n, sig, i0, i1, ...).

    ``lines`` (id, line, n) has the text of each id, at least once.
    """
    long_enough = F.col("n") >= chars_per_edit
    line = F.col("line")
    own_segs = F.array(*(f"i{k}" for k in range(edits + 1)))
    index = distinct.filter(long_enough).select("id", "n", "sig", F.explode(own_segs).alias("seg"))
    segs = stored(index.groupBy("seg").agg(F.count("*").alias("size")), "segs")
    bits = bitmap(segs.withColumnRenamed("seg", "key"), some=F.lit(True), several=F.col("size") > 1)
    met = marked(with_probes(lines.filter(long_enough), edits), "seg", bits, F.col("some")).select("id", "seg", "n", signature(parts(line)).alias("sig"))
    # a line's own segments are in the index already; those that no other line has meet nothing
    own = marked(index.select("id", "seg", "n", "sig"), "seg", bits, F.col("several"))
    probe = stored(met.unionByName(own).dropDuplicates(["id", "seg"]), "probes")
    large = stored(segs.filter(F.col("size") > LARGE_BUCKET).select("seg", F.ceil(F.col("size") / PART).alias("parts")), "large")
    apart = F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig")))
    longer = F.col("x.n") - F.col("y.n")
    once = (longer > 0) | (F.col("x.id") > F.col("y.id"))
    near = (longer >= 0) & (longer <= edits) & once & (apart <= 3 * edits)
    meet = (F.col("x.seg") == F.col("y.seg")) & near
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    pairs = stored(probe.alias("x").join(index.join(large, "seg", "left_anti").alias("y"), meet).select(*ends).distinct(), "pairs")
    # the lines of a crowded segment lie in parts; whoever looks for partners in it goes to all of them
    crowded = stored(index.join(large, "seg").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"), "crowded")
    seekers = stored(probe.join(large, "seg"), "seekers")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowded.select("id")).union(seekers.select("id")).distinct(), "needed")
    wanted = marked(lines.select("id", "line"), "id", bitmap(needed.select(F.col("id").alias("key")), some=F.lit(True)), F.col("some"))
    # an inner join: a semi join would be pushed below the bitmap, and shuffle all lines
    text = stored(wanted.join(needed, "id").dropDuplicates(["id"]), "texts")
    la, lb = (text.select(F.col("id").alias(side), F.col("line").alias(f"l{side}")) for side in "ab")
    # few bytes and much work each: as many tasks as the session has partitions, which a small table would not get by its size; written before
    # they are judged, for a filter would be pushed below the exchange
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = stored(pairs.join(la, "a").join(lb, "b").repartition(tasks, "a", "b"), "compared").filter(within(F.col("la"), F.col("lb"), edits, chars_per_edit))
    asked = seekers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    x, y = (side.join(text, "id").repartition(tasks, "seg", "part").alias(name) for side, name in ((asked, "x"), (crowded, "y")))
    beside = meet & (F.col("x.part") == F.col("y.part"))
    big = x.join(y, beside & within(F.col("x.line"), F.col("y.line"), edits, chars_per_edit)).select(*ends)
    return small.select("a", "b").unionByName(big).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row per line of df: row, doc_id, line_no, words, n_links (to other distinct lines), class_doc_id, class_line_no, first."""
    lines = lines_of(df, id_col, text_col)
    line, n = F.col("line"), F.col("n")
    first, second = line_keys(line)
    long_enough = n >= chars_per_edit
    keys = [f"i{k}" for k in range(edits + 1)]
    place = stored(
        lines.withColumn("between", parts(line)).select(
            "row", "doc_id", "line_no", first.alias("id"), second.alias("key2"), n_words(line, F.col("between")).alias("words"), "n",
            *(F.when(long_enough, _key(n, k, line, *segment(n, k, edits))).alias(i) for k, i in enumerate(keys)),
            F.when(long_enough, signature(F.col("between"))).alias("sig"),
        ),
        "places",
    )

    def merged() -> DataFrame:
        least = [F.min(F.struct("doc_id", "line_no", "row")).alias("f"), F.min("key2").alias("lo"), F.max("key2").alias("hi")]
        return stored(place.groupBy("id").agg(*least, *(F.first(c).alias(c) for c in ("n", "sig", *keys))), "distinct")

    distinct = merged()
    clashes = [r.id for r in distinct.filter("lo != hi").select("id").collect()]  # about n * n / 2 ** 65 of n lines
    if clashes:
        place = place.withColumn("id", F.when(F.col("id").isin(clashes), F.col("key2")).otherwise(F.col("id")))
        distinct = merged()
    found = stored(links(distinct, lines.select(line_id(clashes).alias("id"), "line", "n"), edits, chars_per_edit), "links")
    degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = stored(components(found).withColumnRenamed("node", "id").join(degree, "id").join(distinct.select("id", "f"), "id"), "linked")
    heads = linked.groupBy("comp").agg(F.min("f").alias("head"))
    by_id = distinct.select("id", "f").join(linked.join(heads, "comp").select("id", "n_links", "head"), "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("head", "f").alias("head")
    )
    return place.select("row", "doc_id", "line_no", "words", "id").join(by_id, "id").select(
        "row",
        "doc_id",
        "line_no",
        "words",
        "n_links",
        F.col("head.doc_id").alias("class_doc_id"),
        F.col("head.line_no").alias("class_line_no"),
        ((F.col("row") == F.col("head.row")) & (F.col("line_no") == F.col("head.line_no"))).alias("first"),
    )


def apply(df: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """df without the repeated lines: of each class only its first line stays, whatever share of a document goes.

    A document that has no word left consists of lines that all stand elsewhere; it keeps its row, with what is left of its text, only if
    ``keep_emptied``. ``n_chars`` follows the text.
    """
    numbered = stored(df.withColumn("__n", F.monotonically_increasing_id()), "rows")
    judged = classes(numbered, "__n")
    gone = (
        judged.groupBy(F.col("doc_id").alias("__n"))
        .agg(
            F.every("first").alias("whole"),
            (~F.some("first")).alias("emptied"),
            F.collect_set(F.when(~F.col("first"), F.col("line_no"))).alias("gone"),
        )
        .filter(~F.col("whole"))
        .select("__n", "gone", "emptied")
    )
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    out = numbered.join(gone, "__n", "left").withColumn(
        "text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    )
    if not keep_emptied:
        out = out.filter(F.col("emptied").isNull() | ~F.col("emptied"))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)
