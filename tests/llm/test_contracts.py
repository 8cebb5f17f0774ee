"""The queries with a contract, held against plain Python over whole tables and hand-made rows."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contrail.llm import byte_bpe, jaccard_join, language_id, packing, quality_rules, telephony
from contrail.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    prose = " ".join(f"word{i % 97}" for i in range(300))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, "one", "en", None, 3),
        (5, "One two\nthree four", None, "b", 18),
        (6, prose, "en", "b", 1),
        (6, prose, "en", "b", 1),
        (7, prose + " tail", "en", "b", 1),
        (8, "é ß İ   ünïcode \U0001f600 x\x00y", "de", "c", 1),
        (9, "la la " * 40_000, "fr", "c", 1),
        (10, "# * $ % & | < >\n\n# * $ % & | < >\nend", "en", "c", 1),
        (None, "no id here at all, five words", "en", "c", 1),
        (11, "x" * 70_000, "en", "c", 1),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return made.selectExpr("*", "1 AS row", "'k' AS key", "2 AS cls", "'p' AS path", "3 AS n_words", "4 AS line", "5 AS pivot")


def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return texts(spark, sf)


# -- 1 ---------------------------------------------------------------------------------------------------------


def reference_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_bpe(text):
    ids = reference_encoding.made.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_byte_bpe(spark, sf, docs):
    reference_encoding.made = reference_encoding()
    got = queries()["op1_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_bpe(docs[r.doc_id])
    odd = odd_rows(spark)
    got = byte_bpe.digest(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = [(r.doc_id, *expected_bpe(r.text)) for r in odd.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_byte_bpe_encode_and_decode(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    odd = odd_rows(spark)
    back = byte_bpe.decode(byte_bpe.encode(odd, path, public_tokenizers.PATTERN), path).collect()
    want = Counter((r.text or "").encode() for r in odd.collect())
    assert Counter(bytes(r.bytes) for r in back) == want


# -- 3 ---------------------------------------------------------------------------------------------------------


def base_figures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def expected_quality(rows, min_docs, share, keep_words):
    """rows: (text, host) in order."""
    norm = lambda line: " ".join(re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(line))
    hosts, seen = Counter(h for _, h in rows), Counter()
    for text, host in rows:
        seen.update({(host, n) for line in (text or "").split("\n") if (n := norm(line))})
    out = []
    for text, host in rows:
        base = base_figures(text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        removed = sum(
            len(n.split(" "))
            for line in (text or "").split("\n")
            if (n := norm(line)) and seen[host, n] >= min_docs and seen[host, n] > share * hosts[host]
        )
        out.append((*base, failed, not failed and base[0] - removed >= keep_words * base[0], removed))
    return out


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]


@pytest.mark.parametrize("limits", [(quality_rules.MIN_DOCS, quality_rules.SHARE, quality_rules.KEEP_WORDS), (2, 0.02, 0.9)])
def test_quality_rules(spark, sf, limits):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    rows = df.collect()
    want = {r.doc_id: w for r, w in zip(rows, expected_quality([(r.text, r.source) for r in rows], *limits), strict=True)}
    got = quality_rules.verdicts(df, min_docs=limits[0], share=limits[1], keep_words=limits[2]).collect()
    assert {r.doc_id: tuple(r[c] for c in FIGURES) for r in got} == want


def test_quality_rules_odd_rows(spark):
    df = odd_rows(spark)
    plain = df.select("doc_id", "text", "source")
    rows = plain.collect()
    want = Counter(zip((r.doc_id for r in rows), expected_quality([(r.text, r.source) for r in rows], 2, 0.1, 0.5), strict=True))
    for wide in (plain, df.withColumn("removed", F.lit("x")).withColumn("kept", F.lit(1))):  # columns with the names of figures
        got = quality_rules.verdicts(wide, min_docs=2).collect()
        assert Counter((r.doc_id, tuple(r[c] for c in FIGURES)) for r in got) == want
    kept = quality_rules.apply(df, min_docs=2)
    assert kept.columns == df.columns
    assert kept.count() == sum(w[1][6] for w in want.elements())
    assert quality_rules.apply(df.limit(0)).count() == 0


def test_quality_rules_removes_lines(spark):
    body = lambda i: " ".join(f"w{i}_{k}" for k in range(12))
    rows = [(i, f"{body(i)}\nSame  LINE here\n\n{body(i + 100)}", "en", "h", 0) for i in range(5)]
    rows.append((99, "same line here\nsame line here\na b c d e f", "en", "h", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.apply(df, min_docs=3).collect()}
    want = {i: f"{body(i)}\n\n{body(i + 100)}" for i in range(5)}
    want[99] = "a b c d e f"
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_quality_rules_in_large_and_small_hosts(spark):
    """20 of 1,000 documents are enough in a hot host; in a host of 6, 4 are, 3 are not."""
    body = lambda i: " ".join(f"w{i}_{k}" for k in range(12))
    rows = [(i, f"{body(i)}\n{'hot line' if i < 20 else f'own {i}'}\n{'rarer line' if i < 19 else f'more {i}'}", "hot") for i in range(1000)]
    rows += [(2000 + i, f"{body(2000 + i)}\n{'small line' if i < 4 else 'x'}\n{'half line' if i < 3 else f'y{i}'}", "small") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed_words for r in quality_rules.verdicts(df).collect()}
    assert got == {d: 2 * (d < 20 or 2000 <= d < 2004) for d, _, _ in rows}


# -- 4 ---------------------------------------------------------------------------------------------------------


def test_telephony(spark, sf, docs):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), odd_rows(spark)):
        by_text = {}
        want, got = Counter(), Counter()
        for r in df.collect():
            raw = (r.text or "").encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want[r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        for r in telephony.digest(df).collect():
            got[r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32] += 1
            assert by_text.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
            assert r.media_bytes > r.payload_bytes
        assert got == want


def test_companding_tables():
    """Against the published segment rules, code by code."""
    for code in range(256):
        u = ~code & 0xFF
        size = ((2 * (u & 15) + 33) << (u >> 4 & 7)) - 33
        assert telephony.TABLES[telephony.MULAW][code] == 4 * (-size if u & 0x80 else size)
        a = code ^ 0x55
        low, seg = a & 15, a >> 4 & 7
        size = 2 * low + 1 if seg == 0 else (2 * low + 33) << (seg - 1)
        assert telephony.TABLES[telephony.ALAW][code] == 8 * (size if a & 0x80 else -size)


def test_adpcm_against_scalar_decoder():
    raw = np.random.default_rng(3).integers(0, 256, (7, 64), dtype=np.uint8)
    moves = [-1, -1, -1, -1, 2, 4, 6, 8]
    for block, got in zip(raw, telephony.adpcm(raw), strict=True):
        value, index = struct.unpack("<h", block[:2].tobytes())[0], min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                diff = step >> 3
                diff += (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
                value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
                index = max(0, min(88, index + moves[nibble & 7]))
                want.append(value)
        assert got.tolist() == want


# -- 7 ---------------------------------------------------------------------------------------------------------


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected_join(rows):
    """(doc_id, text) -> rows of (doc_id, n_shingles, component_id); all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(i, j) for h in holders.values() for k, i in enumerate(h) for j in h[k + 1 :]}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_jaccard_join(spark, where):
    df = spark.read.parquet(f"/root/testdata/{where}/documents.parquet")
    want = expected_join([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert Counter(map(tuple, jaccard_join.join(df).select("doc_id", "n_shingles", "component_id").collect())) == want


def near_copies(seed, words=60, groups=12, copies=9, edits=8):
    """Groups of texts at all distances around the limit, with a passage that all share."""
    rng = np.random.default_rng(seed)
    shared = " ".join(f"common{i}" for i in range(30))
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, edits))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 1_000_000)}"
            if rng.random() < 0.3:
                own = own[: int(rng.integers(40, words))]
            out.append((len(out), " ".join(own) + (" " + shared if g % 2 else "")))
    return out


@pytest.mark.parametrize(("seed", "large"), [(1, 512), (2, 64), (3, 3), (4, 2)])
def test_jaccard_join_near_the_limit(spark, monkeypatch, seed, large):
    monkeypatch.setattr(jaccard_join, "LARGE_REGION", large)
    monkeypatch.setattr(jaccard_join, "SPOKES", large)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.join(df).collect())) == expected_join(rows)


def test_jaccard_join_tells_classes_with_one_key_apart(spark, monkeypatch):
    plain = jaccard_join._class_keys

    def weak(grams, off):
        first, second = plain(grams, off)
        return np.where(first == 0, 0, (first & 7) * 2 + 1), second

    monkeypatch.setattr(jaccard_join, "_class_keys", weak)
    rows = near_copies(5, groups=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard_join.join(df).collect())) == expected_join(rows)


def test_jaccard_links_are_complete(spark):
    """Every link between different sets, and every document's class, against all pairs."""
    rows = [*near_copies(6), (900, near_copies(6)[0][1]), (901, None)]
    sets = {d: shingles(t) for d, t in rows}
    name = {}
    for d, s in sorted(sets.items()):
        name.setdefault(s, d)
    kinds = sorted((d, s) for s, d in name.items() if s)
    want = {(a, b) for a, s in kinds for b, t in kinds if a < b and 100 * len(s & t) >= 80 * len(s | t)}
    found, members = jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = found.collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.d - (1 - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b]))) < 1e-12 for r in got)
    assert {tuple(r) for r in members.collect()} == {(d, name[s]) for d, s in sets.items() if s}


def test_jaccard_join_odd_rows(spark):
    df = odd_rows(spark)
    want = expected_join([(r.doc_id, r.text) for r in df.collect()])
    assert Counter(map(tuple, jaccard_join.join(df).collect())) == want
    assert jaccard_join.join(df.limit(0)).count() == 0
    assert jaccard_join.apply(df).columns == df.columns


# -- 8 ---------------------------------------------------------------------------------------------------------


def test_language_id(spark, sf):
    got = queries()["op8_language_id"](spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(rows)
    right = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
        text = rows[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        if r.held_out and rows[r.doc_id].lang is not None and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == rows[r.doc_id].lang
    assert total > 100
    assert right / total > 0.97, right / total


def test_language_model_against_plain_counts():
    """Exact code lengths by escape method C with exclusion, recomputed symbol by symbol."""
    import pyarrow as pa

    from contrail.llm.textvec import blocks

    train = {"aa": ["abab abba aab", "banana abab"], "bb": ["zebra zoo azure", "buzz zzz oz"]}

    def grams(texts):
        c = Counter()
        for t in texts:
            raw = b"\n\n\n" + t.encode().lower()
            c.update(int.from_bytes(raw[i - 3 : i + 1], "big") for i in range(3, len(raw)))
        keys = np.array(sorted(c), dtype=np.int64)
        return keys, np.array([c[k] for k in keys.tolist()], dtype=np.int64)

    model = language_id.Model({lang: grams(t) for lang, t in train.items()})
    tests = ["abab zebra", "q?", "banana oz", "zzzz abba"]
    block = next(blocks(pa.array(tests)))
    got = model.code_lengths(block)
    for k, lang in enumerate(model.langs):
        tree = [defaultdict(Counter) for _ in range(4)]
        for t in train[lang]:
            raw = b"\n\n\n" + t.encode()
            for i in range(3, len(raw)):
                for order in range(4):
                    tree[order][raw[i - order : i]][raw[i]] += 1

        def dist(order, context, tree=tree):
            """Probability of each byte value after the context, at this order and below."""
            if order < 0:
                return dict.fromkeys(range(256), 1 / 256)
            lower = dist(order - 1, context[1:])
            c = tree[order].get(context, {})
            if not c:
                return lower
            total, kinds = sum(c.values()), len(c)
            spare = sum(p for b, p in lower.items() if b not in c)
            return {b: c[b] / (total + kinds) if b in c else kinds / (total + kinds) * lower[b] / spare for b in lower}

        for t, bits in zip(tests, got[:, k], strict=True):
            raw = b"\n\n\n" + t.encode()
            want = sum(-np.log2(dist(3, raw[i - 3 : i])[raw[i]]) for i in range(3, len(raw)))
            assert abs(bits - want) < 1e-9 * max(1, want), (lang, t, bits, want)


def test_language_parts_do_not_matter(monkeypatch):
    """Cutting a block into parts changes neither the runs of bytes nor the code lengths."""
    import pyarrow as pa

    from contrail.llm.textvec import blocks

    rng = np.random.default_rng(8)
    texts_ = ["".join("abC \n"[k] for k in rng.integers(0, 5, int(n))) for n in rng.integers(0, 9, 60)]
    block = next(blocks(pa.array(texts_)))
    want = [int.from_bytes((b"\n\n\n" + t.lower().encode())[i : i + 4], "big") for t in texts_ for i in range(len(t))]
    keys, n = np.unique(np.array(want), return_counts=True)
    model = language_id.Model({"x": (keys, n)})
    whole = model.code_lengths(block)
    for size in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(language_id, "PART_BYTES", size)
        assert np.concatenate([g for _, g in language_id._parts(block)]).tolist() == want
        assert np.allclose(model.code_lengths(block), whole)


def test_language_id_with_many_labels(spark):
    """70 labels, each with letters of its own: all are learned."""
    rows = []
    for i in range(700):
        rng = np.random.default_rng(i)
        own = [chr(0x4E00 + 10 * (i % 70) + k) for k in range(10)]
        rows.append((i, " ".join("".join(rng.choice(own, 5)) for _ in range(30)), f"l{i % 70:02d}"))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {d: lang for d, _, lang in rows}


def test_language_id_odd_rows(spark):
    df = odd_rows(spark)
    got = language_id.identify(df).collect()
    assert len(got) == df.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    assert language_id.apply(df).columns == df.columns


# -- 9 ---------------------------------------------------------------------------------------------------------


def hold_packing(got, want_ids):
    """got: rows of pieces; want_ids: doc_id -> ids. Every rule of the contract."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = want_ids[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want_ids)
    for d, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(want_ids[d])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def word_ids(texts_):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in texts_.items()}


def test_packing(spark, sf, docs):
    want = word_ids(docs)
    assert hold_packing(queries()["op9_packing"](spark, sf).collect(), want) < 0.02 * sum(map(len, want.values()))
    odd = {r.doc_id: r for r in odd_rows(spark).filter("doc_id IS NOT NULL").collect()}
    df = odd_rows(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    path = public_tokenizers.path("word_bpe_49k.json")
    hold_packing(packing.pack(df, path).collect(), word_ids({d: r.text for d, r in odd.items()}))
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_of_small_shards(spark, sf, docs, monkeypatch):
    """Neighbours of a seed share words with it; all windows but a shard's last are full."""
    idf = np.ones(50_000)
    rng = np.random.default_rng(1)
    topics = [np.concatenate([rng.integers(100 * (i % 5), 100 * (i % 5) + 100, 900), [49_000]]) for i in range(40)]
    pieces = packing.pack_shard([t.astype("<u4") for t in topics], idf, 900.0)
    total = defaultdict(int)
    members = defaultdict(list)
    for d, _, n, seq, _ in pieces:
        total[seq] += n
        members[seq].append(d % 5)
    assert all(n == 4096 or n & (n - 1) == 0 for n in total.values())
    full = [m for s, m in members.items() if total[s] == 4096]
    assert sum(len(set(m)) == 1 for m in full) >= len(full) - 5


def test_packing_asks_on_until_the_window_is_full():
    """Short documents: far more than a first block of neighbours fit a window. Also against plain scores over all terms."""
    rng = np.random.default_rng(2)
    texts_ = [rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 30).astype("<u4") for i in range(2000)]
    pieces = packing.pack_shard(texts_, np.ones(500), 30.0)
    total, members = defaultdict(int), defaultdict(set)
    for doc, _, n, seq, _ in pieces:
        total[seq] += n
        members[seq].add(doc % 4)
    full = [m for s, m in members.items() if total[s] == 4096]
    assert sum(len(m) == 1 for m in full) >= len(full) - 4

    words = [rng.integers(0, 2000, 200).astype("<u4") for _ in range(150)]
    idf = rng.random(2000) + 0.1
    index = packing.Index(words, idf, 200.0)
    counts = [Counter(w.tolist()) for w in words]
    weight = lambda t, d: idf[t] * counts[d][t] * 2.2 / (counts[d][t] + 1.2)
    want = {d: sum(weight(t, d) for t in counts[0].keys() & counts[d].keys()) for d in range(1, 150)}
    unused = np.ones(150, dtype=bool)
    unused[0] = False
    got = list(index.neighbours(0, unused))
    assert sorted(got) == sorted(d for d in want if want[d] > 0)
    assert all(want[a] >= want[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_word_ids_match_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        ours = packing.WordIds(f.read())
    t = Tokenizer.from_file(path)
    samples = [
        "Don't  stop\tnow\r\n we'll'd x²³ ¼ naïve ÀÉ İstanbul ſ ß ẞ é é Å  a­ b", "<|endoftext|> <|startoftext|>a",
        "12ab34 a_b-c 　x y 日本語 \U0001f600\U0001f600", "a\x85b\x1cc\x0bd", "", " ", "\n\n", "ΑΣ ΑΣ. ǅ ﬁ ªº µ", "'S 'LL x'RE",
    ]
    rng = np.random.default_rng(5)
    samples += ["".join(chr(c) for c in rng.integers(1, 0x250, 300)) for _ in range(60)]
    samples += ["".join(chr(c) for c in rng.integers(0x20, 0x7F, 300)) for _ in range(60)]
    samples += ["a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>'s", None, " ".join(f"word{i % 911}'s" for i in range(300))]
    want = [[*t.encode(s or "", add_special_tokens=False).ids, 2] for s in samples]
    for block in (1 << 22, 500):
        monkeypatch.setattr(packing, "BLOCK_BYTES", block)
        monkeypatch.setattr(packing, "RUN", block // 10)
        monkeypatch.setattr(packing, "KNOWN_BYTES", block)
        got = []
        for first, ids, off in ours.encoded(pa.array(samples)):
            assert first == len(got)
            got += [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)]
        assert got == want


def test_packing_deals_neighbours_to_one_range(spark, monkeypatch):
    """Documents of one topic, far apart in the input, fill windows together; the topic term is theirs alone."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"topic{'abcdefghij'[i % 10]}x" for _ in range(40)] + [f"w{k}" for k in rng.integers(0, 3000, 60)]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    members = defaultdict(Counter)
    for r in packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect():
        members[r.sequence_id][r.doc_id % 10] += r.length
    alike = sum(m.most_common(1)[0][1] for m in members.values())
    assert alike > 0.8 * sum(sum(m.values()) for m in members.values())


def test_labels_that_have_long_texts_only_are_learned(spark):
    rng = np.random.default_rng(8)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(300)] for lang, letters in {"en": "abcdefgh", "de": "ijklmnop", "fr": "qrstuvwx"}.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(k, text("en", 17), "en") for k in range(50)] + [(100 + k, text("de", 4900), "de") for k in range(50)] + [(200, text("fr", 90_000), "fr"), (201, text("fr", 200_000), "fr")]
    asked = [(300 + k, text(lang, 30), None) for k, lang in enumerate(["en", "de", "fr"] * 5)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string").withColumn("size", F.lit(1)).withColumn("most", F.lit("m"))
    counts = language_id.fit(df)
    assert sorted(counts) == ["de", "en", "fr"]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df.select("doc_id", "text"), counts).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert [got[300 + k] for k in range(15)] == ["en", "de", "fr"] * 5
    # the sample of such a label holds fewer documents, and one at least
    sizes = language_id.sample(df).groupBy("lang").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest")).collect()
    assert {r.lang: r.n for r in sizes} == {"en": 50, "de": 50, "fr": 1}


def test_seventy_labels_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 50)
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 4)
    rows = [(100 * a + k, f"{chr(0x3400 + a)}x" * 40, f"l{a:02d}") for a in range(70) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language_id.fit(df)
    assert len(counts) == 70
    got = language_id.predict(df, counts).collect()
    assert all(r.lang_pred == r.lang for r in got)
