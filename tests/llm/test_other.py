"""The other operators against plain Python, the tokenizers library and DuckDB; odd rows for all."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contrail.llm import license_scan, line_dedup, sharding, token_counts
from contrail.llm.queries import oracle_sql, queries
from contrail.plans.compare import differences

from .test_contracts import WORD, odd_rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def within(a, b, most):
    """Whether the edit distance is at most ``most``, by trying all edits at the first difference."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if not a or not b:
        return max(len(a), len(b)) <= most
    return most > 0 and any(within(x, y, most - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def expected_lines(rows, edits=2, chars_per_edit=10):
    """(row number, doc_id, text) -> rows (doc_id, line_no, n_links, class_doc_id, class_line_no)."""
    places = [(d, i, line, r) for r, d, t in rows if t for i, line in enumerate(t.split("\n")) if WORD.search(line)]
    every = sorted({p[2] for p in places})
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    degree = Counter()
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            most = min(edits, min(len(a), len(b)) // chars_per_edit) if chars_per_edit else edits
            if most and abs(len(a) - len(b)) <= most and within(a, b, most):
                degree.update((a, b))
                root[find(a)] = find(b)
    heads = defaultdict(list)
    for d, i, line, r in places:
        heads[find(line)].append(((d is not None, d), i, r))
    head = {k: min(v) for k, v in heads.items()}
    return Counter((d, i, degree[line], head[find(line)][0][1], head[find(line)][1]) for d, i, line, _ in places)


@pytest.fixture
def small_bitmap(monkeypatch):
    """The size changes what is shuffled and nothing else; test_line_dedup_over_documents runs with the full one."""
    monkeypatch.setattr(line_dedup, "INDEX_BITS", 20)


def edited_lines(seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"wörd{rng.integers(0, 50)}" for _ in range(int(rng.integers(4, 9)))) for _ in range(6)]
    rows = []
    for d in range(25):
        lines = []
        for _ in range(3):
            line = list(base[int(rng.integers(0, 6))])
            for _ in range(int(rng.integers(0, 4))):
                at, kind = int(rng.integers(0, len(line))), int(rng.integers(0, 3))
                if kind == 0:
                    line[at] = "x "[int(rng.integers(0, 2))]
                elif kind == 1:
                    del line[at]
                else:
                    line.insert(at, "y ü"[int(rng.integers(0, 3))])
            lines.append("".join(line))
        few = ["short", "shirt", "fifteen letters", "fifteen, letters", "fifteen. lettres"][d % 5]
        rows.append((d, "\n".join([*lines, "", few, "same tail line of thirty characters or more"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed, small_bitmap):
    rows = edited_lines(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.classes(df).select("doc_id", "line_no", "n_links", "class_doc_id", "class_line_no").collect()
    assert Counter(map(tuple, got)) == expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)])


@pytest.mark.parametrize(("edits", "chars_per_edit"), [(2, 0), (1, 0), (3, 7), (0, 0)])
def test_line_dedup_thresholds(spark, edits, chars_per_edit, small_bitmap):
    """The plain threshold links short lines too, those of one character among them."""
    rows = [*edited_lines(5), (40, "a\nb\nab\nabc\nyes\nno\n\u00fc\n\U0001f600x"), (41, "\U0001f600\nabd\nx\nno"), (42, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.classes(df, edits=edits, chars_per_edit=chars_per_edit).select("doc_id", "line_no", "n_links", "class_doc_id", "class_line_no").collect()
    assert Counter(map(tuple, got)) == expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)], edits, chars_per_edit)


def test_line_dedup_crowded_segments_in_parts(spark, monkeypatch, small_bitmap):
    """All lines of a template share its segments, which lie in several parts."""
    monkeypatch.setattr(line_dedup, "PART", 16)
    rows = [(k, f"Posted on the forum by user {1000 + k * 7919 % 9000} at noon today") for k in range(150)]
    got = line_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "line_no", "n_links", "class_doc_id", "class_line_no").collect()
    assert Counter(map(tuple, got)) == expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)])


def test_line_dedup_over_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries()["op5_line_dedup"](spark, sf).select("doc_id", "line_no", "n_links", "class_doc_id", "class_line_no").collect()
    assert Counter(map(tuple, got)) == expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)])


def test_line_dedup_tells_lines_with_one_key_apart(spark, monkeypatch, small_bitmap):
    plain = line_dedup.line_keys
    monkeypatch.setattr(line_dedup, "line_keys", lambda x: (F.pmod(plain(x)[0], F.lit(5)), plain(x)[1]))
    monkeypatch.setattr(line_dedup, "LARGE_BUCKET", 3)
    rows = edited_lines(4)
    got = line_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "line_no", "n_links", "class_doc_id", "class_line_no").collect()
    assert Counter(map(tuple, got)) == expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)])


def test_line_words(spark):
    lines = ["a b c", " a  b ", "a\tb\x0bc\x0cd\re", "x", "\u00a0 y", "\u00e9\u00e9 \u00e9"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.w for r in df.select(line_dedup.n_words(F.col("line")).alias("w")).collect()] == [len(WORD.findall(x)) for x in lines]


def test_banded_distance(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(150):
        a = "".join("abc"[k] for k in rng.integers(0, 3, int(rng.integers(8, 30))))
        b = list(a)
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(b)))
            b[at : at + int(rng.integers(0, 2))] = ["abcd"[int(rng.integers(0, 4))]] * int(rng.integers(0, 2))
        if abs(len(a) - len(b)) <= 2 and len(b) > 4:
            pairs.append((a, "".join(b)))
    short = ["a", "b", "ab", "ba", "abc", "cab"]
    pairs += [(a, b) for a in short for b in short if abs(len(a) - len(b)) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.banded_distance(F.split("a", ""), F.split("b", ""), 2).alias("d")).collect()
    for r in got:
        want = edit_distance(r.a, r.b)
        assert r.d == want if want <= 2 else r.d > 2, r
    assert sorted(r.d <= 2 for r in got) == sorted(r.d for r in df.select(line_dedup.within(F.col("a"), F.col("b"), 2, 0).alias("d")).collect())


def test_line_dedup_within_two_edits(spark):
    """All pairs of short words, which reach every way in which two edits can stand at both ends, also behind and before a common part."""
    short = ["".join(x) for n in range(1, 5) for x in itertools.product("ab\u00fc" if n < 4 else "ab", repeat=n)]
    pairs = [(x + a + y, x + b + y) for x, y in (("", ""), ("ba", "\U0001f600a")) for a in short for b in short if abs(len(a) - len(b)) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2):
        near = df.filter(F.abs(F.char_length("a") - F.char_length("b")) <= edits)
        got = {(r.a, r.b): r.d for r in near.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits, 0).alias("d")).collect()}
        assert got == {(a, b): within(a, b, edits) for a, b in pairs if abs(len(a) - len(b)) <= edits}


def test_line_dedup_bitmap_holds_back_strangers(spark, small_bitmap):
    """With 30,000 hashes in a million bits, of others less than one in a hundred passes, and none of the hashes is held back."""
    own = spark.range(30_000).select(F.xxhash64("id").alias("key"))
    bits = line_dedup.bitmap(own, some=F.lit(True))
    assert line_dedup.marked(own, "key", bits, F.col("some")).count() == 30_000
    others = spark.range(1_000_000, 1_100_000).select(F.xxhash64("id").alias("key"))
    assert line_dedup.marked(others, "key", bits, F.col("some")).count() < 1_000


def test_line_dedup_bitmap_is_broadcast_in_its_own_size(spark, monkeypatch):
    """The table of rows that Spark makes of it grows by doubling and must not be doubled for a few bytes."""
    monkeypatch.setattr(line_dedup, "INDEX_BITS", 24)
    own = spark.range(1000).select(F.xxhash64("id").alias("key"))
    met = line_dedup.marked(own, "key", line_dedup.bitmap(own, some=F.lit(True)), F.col("some"))
    assert len(met.collect()) == 1000
    sizes, plans = [], [met._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "BroadcastExchange":
            sizes.append(plan.metrics().apply("dataSize").value())
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
    assert len(sizes) == 1 and 1.8e6 < sizes[0] < 1.1 * (1 << 21)


def test_line_dedup_odd_rows(spark, small_bitmap):
    df = odd_rows(spark)
    assert line_dedup.classes(df).count() == sum(1 for r in df.collect() for x in (r.text or "").split("\n") if WORD.search(x))
    assert line_dedup.apply(df).columns == df.columns
    assert line_dedup.apply(df).count() == df.count()
    assert line_dedup.classes(df.limit(0)).count() == 0


def test_line_dedup_removes_every_repeat(spark, small_bitmap):
    """The stage against brute force: borrowed lines go whatever their share of the document; emptied documents go as a whole."""
    own = lambda d, n: "\n".join(" ".join(f"own{d}x{k}y{j}" for j in range(6)) for k in range(n))
    shared = "\n".join(" ".join(f"shared{k}y{j}" for j in range(6)) for k in range(4))
    rows = [*edited_lines(3), (30, own(30, 4) + "\n" + shared), (31, shared + "\n\n" + own(31, 1)), (32, own(32, 20) + "\n" + shared), (33, shared)]
    want = {d: t.split("\n") for d, t in rows}
    for d, i, _, head, at in expected_lines([(k, d, t) for k, (d, t) in enumerate(rows)]):
        if (d, i) != (head, at):
            want[d][i] = None
    want = {d: "\n".join(x for x in t if x is not None) for d, t in want.items()}
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.apply(df).collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()}
    assert got[31][0] == "\n" + own(31, 1)
    left = {r.doc_id for r in line_dedup.apply(df, keep_emptied=False).collect()}
    assert left == {d for d, t in want.items() if WORD.search(t)}
    assert 33 not in left


@pytest.mark.parametrize("name", ["op2_license_scan", "op6_sharding"])
def test_oracle(spark, name):
    assert differences(spark, "/root/testdata/sf0.01", queries()[name], oracle_sql()[name]) == ""


def test_license_scan_odd_rows(spark):
    df = odd_rows(spark)
    got = license_scan.scan(df, F.col("source"))
    assert got.count() == df.count()
    assert license_scan.scan(df.limit(0), F.col("source")).count() == 0


def test_license_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "print()"),
        (3, "a/b/LICENSE.md", "Licensed under CC BY 4.0."),
        (4, "ab/x.py", "print()"),
        (5, None, "text"),
        (6, "a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (7, "a/b/z.py", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.from_dir) for r in license_scan.scan(df, F.col("p")).collect()}
    assert got == {1: ("MIT", None), 2: ("CC-BY-4.0", "a/b"), 3: ("CC-BY-4.0", None), 4: (None, None), 5: (None, None), 6: ("Apache-2.0", None), 7: ("CC-BY-4.0", "a/b")}


def test_license_of_wrapped_headers_and_licence_files(spark):
    import textwrap

    notice = dict(reversed(license_scan.TEMPLATES))  # the first of each name
    longest = {n: max((t for m, t in license_scan.TEMPLATES if m == n), key=len) for n in notice}
    code = "\n".join(f"def f{i}(a, b):\n    return a * {i} + b" for i in range(60))
    rows = [("blank", "", None), ("none", code, None), ("null", None, None)]
    for name in ("MIT", "GPL-3.0", "GPL-2.0", "Apache-2.0", "MPL-2.0", "BSD"):
        for mark, gap in (("# ", "\n"), (" * ", "\n\n"), ("// ", "\n")):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(f"Copyright 2020 The Authors. {longest[name]}", 60))
            rows.append((f"{name}{mark}", wrapped + gap + code, name))
    rows.append(("bsd", "Copyright (c) 2001, A. N. Other\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(longest["BSD"], 70)) + "\n\n" + code, "BSD"))
    rows.append(("own", "All rights reserved.\n\n" + code, "proprietary"))
    import os

    for file, name in (("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if os.path.exists(f"/usr/share/common-licenses/{file}"):
            with open(f"/usr/share/common-licenses/{file}") as f:
                rows.append((file, f.read(), name))
    df = spark.createDataFrame(rows, "doc_id string, text string, want string")
    got = {r.doc_id: r.own_license for r in license_scan.scan(df, F.concat(F.lit("a/"), "doc_id")).collect()}
    assert got == {d: w for d, _, w in rows}


def test_license_scan_after_a_shuffle(spark):
    """Row numbers of a shuffled and joined input stay with their rows."""
    made = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Released under the MIT License.', IF(id % 3 = 1, 'Licensed under CC BY 4.0.', 'no word')) AS text")
    df = made.repartition(13).join(spark.range(4000).withColumnRenamed("id", "doc_id").repartition(7), "doc_id")
    got = {r.doc_id: r.own_license for r in license_scan.scan(df, F.lit("a/x")).collect()}
    assert got == {d: ["MIT", "CC-BY-4.0", None][d % 3] for d in range(4000)}


@pytest.mark.parametrize("limit", [200, 3000])
def test_sharding_splits(spark, sf, limit):
    df = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 5"))
    got = sharding.assign(df, limit).collect()
    assert len(got) == df.count()
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
    assert all(size[s] <= limit or count[s] == 1 for s in size)
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    below = lambda p: sum(n for s, n in size.items() if s.startswith(p))
    assert all(below(s[:-1]) > limit for s in shards if s)


def test_sharding_odd_rows(spark):
    df = odd_rows(spark)
    assert sharding.assign(df, 1000).count() == df.count()
    assert sharding.assign(df.limit(0)).count() == 0


def expected_counts(texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces, _ = token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    byte = [(f"<0x{b:02X}>", -1e9) for b in range(256)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *byte, *pieces], 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return [len(t.encode(x or "").ids) for x in texts]


def test_token_counts(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    df = spark.createDataFrame(rows)
    got = {r.doc_id: r.n_tokens for r in token_counts.count(df, path).collect()}
    want = expected_counts([r.text for r in rows])
    assert [got[r.doc_id] for r in rows] == want
    odd = odd_rows(spark)
    want = Counter(zip((r.doc_id for r in odd.collect()), expected_counts([r.text for r in odd.collect()]), strict=True))
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count(odd, path).collect()) == want
    assert token_counts.count(df.limit(0), path).count() == 0


def test_token_counts_of_a_long_text_without_a_space():
    """Memory does not grow with a pre-token; its count is that of its repeated part."""
    import resource

    counter = token_counts.Counter(*token_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "\u4e16\u754c" * 1_000_000
    n, m = counter.text(text), counter.text(text[:2000])
    assert abs(n - 1000 * m) <= 2000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000
    assert not any(len(x) > token_counts.CACHE_CHARS for x in counter.cache)


def test_pipeline(spark, sf, small_bitmap):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = c.stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = c.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
