"""Alignment of two vocabularies, whitening and SimHash, held against plain Python over whole tables and hand-made rows."""

from __future__ import annotations

import hashlib
import importlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from contrail.llm import alignment, jaccard_join, simhash, whitening
from contrail.llm.components import components
from contrail.llm.queries import queries

from .test_contracts import WORD, odd_rows, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# -- 11 --------------------------------------------------------------------------------------------------------


class Plain:
    """Whole texts through both libraries, offsets compared one by one."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        stand_in = alignment._byte_level()
        self.raw = {i: bytes(stand_in[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in stand_in for c in t)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def aligned(self, text):
        """(a ids, b ids, groups, links) or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        pieces = [self.raw[i] for i in a], [self.piece(i) for i in b]
        if not b"".join(pieces[0]) == b"".join(pieces[1]) == (" " + text).encode():
            return None
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            for x in range(i, i2):
                for y in range(j, j2):
                    left = max(ends[0][x] - len(pieces[0][x]), ends[1][y] - len(pieces[1][y]))
                    if left < min(ends[0][x], ends[1][y]):
                        links.append((a[x], b[y]))
            i, j = i2, j2
        return a, b, groups, links


def expected_alignment(rows):
    """Rows (doc_id, text) -> tuples of the contract."""
    plain, made = Plain(), []
    known = {}
    for _, text in rows:
        if text not in known:
            known[text] = plain.aligned(text)
    counts = Counter(pair for _, text in rows if known[text] for pair in set(known[text][3]))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    for doc, text in rows:
        if known[text] is None:
            made.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = known[text]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == most[p[0]] for p in links)
        made.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return made


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df, columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def test_alignment_of_all_documents(spark, sf):
    got = rows_of(queries()["op11_cross_tokenizer_alignment"](spark, sf), COLUMNS)
    assert got == sorted(map(repr, expected_alignment([*texts(spark, sf).items()])))


def more_odd_rows(spark):
    rng = np.random.default_rng(11)
    alphabet = [*"ab '\n\t\r\x0b\x0c\x1c\x85\xa0 　​▁é\U0001f600.,;1<s>", "'re", "  ", "\n\n", "▁▁", "<|endoftext|>", "</s>", "<0x41>", ";\r"]
    rows = [(100 + k, "".join(rng.choice(alphabet, 60))) for k in range(150)]
    plain = [x for x in alphabet if "▁" not in x]
    rows += [(300 + k, "".join(rng.choice(plain, 80))) for k in range(150)]
    rows += [(500, " "), (501, "\n"), (502, "▁"), (503, "a▁ b"), (504, "  lead and trail  "), (505, "<|endoftext|> <s> <unk>"), (505, "same id"), (506, "\x00 a\x00")]
    return odd_rows(spark).select("doc_id", "text", "row", "key").unionByName(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'k' AS key"))


@pytest.mark.parametrize(("run", "chars"), [(200_000, 1 << 24), (7, 400)])
def test_alignment_of_odd_rows(spark, monkeypatch, run, chars):
    monkeypatch.setattr(alignment, "RUN", run)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", chars)
    odd = more_odd_rows(spark).repartition(5).withColumn("block", F.lit(7)).withColumn("segments", F.lit("s"))
    want = expected_alignment([(r.doc_id, r.text) for r in odd.collect()])
    assert rows_of(alignment.digest(odd, A, B), COLUMNS) == sorted(map(repr, want))
    groups = alignment.align(odd, A, B).collect()
    assert Counter(hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in groups) == Counter(w[-1] for w in want)


def test_alignment_of_nothing(spark):
    assert alignment.digest(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    one = alignment.digest(spark.createDataFrame([(None, None)], "doc_id long, text string"), A, B).collect()
    assert [tuple(r) for r in one] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_break_characters():
    """A space and a line feed never follow other characters within a token of these files; some piece holds a carriage return after a letter or sign."""
    with open(A) as f, open(B, "rb") as g:
        a_json, b_model = f.read(), g.read()
    breaks = alignment.break_characters(a_json, b_model)
    assert " " in breaks
    assert "\n" in breaks
    assert "\r" not in breaks
    assert alignment.is_identity(b_model)
    assert not alignment.is_identity(b_model + alignment._field(3, alignment._field(1, b"nmt_nfkc")))
    assert alignment.break_characters(a_json.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type": "NFC"}'), b_model) == ""
    for pattern in (alignment.segment_pattern(breaks), alignment.segment_pattern("")):
        for text in (" a  b\n c\rd \re  ", " ", " \n\r ", " a b  c"):
            assert "".join(pattern.findall(text)) == text


# -- 12 --------------------------------------------------------------------------------------------------------


def expected_whitening(rows, most=16):
    """Rows (id, vector or None) -> {id: (n, deviation)}, eigenvalues and the covariance, in exact numbers as far as they go."""
    kept = [(i, [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    y = [[n * x[k] - sums[k] for k in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    return kept, n, sums, v, values[::-1][:most], vectors[:, ::-1][:, :most]


def held(got, rows, tolerance=1e-6):
    kept, n, sums, v, values, vectors = expected_whitening(rows)
    k = len({r.component for r in got})
    assert Counter(r.vec_id for r in got) == Counter({i: k * c for i, c in Counter(i for i, _ in kept).items()})
    assert {r.n for r in got} == {n}
    deviation = defaultdict(set)
    for i, x in kept:
        deviation[i].add(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
    assert all(r.deviation in deviation[r.vec_id] for r in got)
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-6)
        assert r.identity_error <= 1e-4
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id, r.deviation][r.component] = r.whitened
    signs = {}
    for i, x in kept:
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        want = centred @ vectors / np.sqrt(np.maximum(values, 1e-300))
        for c, w in by[i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))].items():
            if abs(want[c - 1]) > 1e-3:
                signs.setdefault(c, np.sign(w * want[c - 1]))
                assert w == pytest.approx(signs[c] * want[c - 1], rel=tolerance, abs=tolerance)
    return k


def test_whitening_of_all_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert held(queries()["op12_whitening"](spark, sf).collect(), rows) == 16


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=5) * [100, 10, 1, 0.3, 0]).tolist()) for k in range(200)]
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [1.0, float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0, 0.0])]
    rows += [(904, [0.5, 0.5, 0.5, 0.5, 0.0])] * 400  # one vector holds most rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = whitening.whiten(df.selectExpr("*", "1 AS x", "2 AS n", "3 AS component")).collect()
    assert held(out, rows) == 4  # the last dimension does not vary
    ragged = df.unionByName(spark.createDataFrame([(905, [1.0]), (906, [])], df.schema))
    assert whitening.whiten(ragged).count() == len(out)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 904")).count() == 0
    assert whitening.whiten(df.filter("vec_id IN (900, 902)")).count() == 0


def test_whitening_of_large_entries(spark):
    rows = [(k, [float(k) * 2.0**40, float(k * k)]) for k in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    kept, n, sums, *_ = expected_whitening(rows)
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in kept}
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 2**63 else None for i, w in want.items()}
    huge = spark.createDataFrame([(1, [1e18, 1.0]), (2, [-3e16, 2.0]), (3, [2.9e16, 4.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(huge).collect()} == {2, 3}


def test_jacobi():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 33):
        x = rng.normal(size=(200, d)) * 10.0 ** -np.arange(d).clip(0, 6)
        v = x.T @ x
        values, vectors = whitening.jacobi(v)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=1e-9, atol=1e-13 * values[0])
        assert (np.diff(values) <= 0).all()
    graded = np.array([[1e20, 1e9, 0], [1e9, 1.0, 1e-9], [0, 1e-9, 1e-16]])
    values, _ = whitening.jacobi(graded)
    assert values[1] == pytest.approx(1.0 - 1e-2, rel=1e-6)
    assert values[2] == pytest.approx(1e-16 - 1e-18 / (1 - 1e-2), rel=1e-3)


# -- 13 --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius=3):
    """Distinct fingerprints -> representative, by trying all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= radius:
                root[find(q)] = find(p)
    return {p: find(p) for p in prints}


def expected_simhash(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    comp, least = plain_components(prints), {}
    for (doc, _), p in zip(rows, prints, strict=True):
        if doc is not None:
            least[comp[p]] = min(least.get(comp[p], doc), doc)
    return [(doc, f"{p:016x}", least.get(comp[p])) for (doc, _), p in zip(rows, prints, strict=True)]


SIMHASH = ["doc_id", "fingerprint", "component_id"]


def test_simhash_of_all_documents(spark, sf):
    rows = [*texts(spark, sf).items()]
    assert rows_of(queries()["op13_simhash"](spark, sf), SIMHASH) == sorted(map(repr, expected_simhash(rows)))


def test_simhash_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 1000)
    odd = odd_rows(spark).selectExpr("*", "1 AS mask", "2 AS fingerprint", "3 AS component_id", "4 AS least")
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "with no id"), (None, "WITH no\tid"), (50, "Éa ſ A"), (51, "éa s a")]
    more = odd.select("doc_id", "text", "fingerprint").unionByName(spark.createDataFrame(rows[-4:], "doc_id long, text string").withColumn("fingerprint", F.lit(2)))
    assert rows_of(simhash.near_duplicates(more), SIMHASH) == sorted(map(repr, expected_simhash(rows)))
    assert simhash.near_duplicates(more.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_covering_masks(radius):
    rng = np.random.default_rng(radius)
    for free in ((1 << 64) - 1, int(rng.integers(1, 1 << 62)) | 1 << 63):
        places = [b for b in range(64) if free >> b & 1]
        masks = simhash.covering_masks(radius, free)
        assert len(masks) == 2 ** (radius + 1) - 1
        assert all(m & ~free == 0 for m in masks)
        for _ in range(300):
            differing = sum(1 << int(b) for b in rng.choice(places, radius, replace=False))
            assert any(m & differing == 0 for m in masks)


@pytest.mark.parametrize("most", [None, 3, 40])
def test_simhash_links_reach_all(spark, most):
    """Balls of near values, a chain, values that differ in high bits only: with buckets of any size the components of all pairs."""
    rng = np.random.default_rng(9)
    values = {0, 1, (1 << 64) - 1, 1 << 63, 0x7FFFFFFFFFFFFFFF}
    for _ in range(6):
        centre = int(rng.integers(0, 1 << 63)) << 1 | 1
        for _ in range(60):
            values.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    chain = int(rng.integers(0, 1 << 63))
    for step in range(20):
        chain ^= 0b111 << 3 * step
        values.add(chain)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fingerprint long"), most=most).collect()
    root = {v: v for v in values}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    full = (1 << 64) - 1
    for r in found:
        a, b = r.a & full, r.b & full
        assert (a ^ b).bit_count() <= 3
        root[find(a)] = find(b)
    want = plain_components(values)
    parts = lambda f: {frozenset(v for v in values if f(v) == c) for c in {f(v) for v in values}}
    assert parts(find) == parts(want.__getitem__)


def test_jaccard_links_are_thinned(spark):
    """Spokes with many hubs each: about as many links as classes are left, and they connect the same classes."""
    rng = random.Random(5)
    links = [(1000 * part + 100 + k, 1000 * part + rng.randrange(30)) for part in range(3) for k in range(100) for _ in range(20)]
    links += [(4000, 5000), (5000, 4000), (6000, 6001), (6001, 6002)]
    df = spark.createDataFrame(sorted(set(links)), "spoke long, hub long")
    thin = jaccard_join._thinned(df)
    assert thin.count() <= 3 * (100 + 30 * 29 // 2) + 4 < len(set(links))
    named = lambda x: {(r.node, r.comp) for r in components(x).collect()}
    assert named(thin) == named(df.toDF("a", "b"))


@pytest.mark.parametrize("seed", range(3))
def test_components_end_with_stars(spark, monkeypatch, seed):
    """Each round leaves fewer crossed nodes; no round is made to see that stars are left, and none for links that are stars at once."""
    rng = random.Random(seed)
    tables = []
    module = importlib.import_module("contrail.llm.components")
    monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: tables.append(name) or f(df, name))
    stars = [(1000 * k + j, 1000 * k) for k in range(5) for j in range(1, 9)]
    crossed = [(k, k + 1) for k in range(20_000, 20_040)] + [(30_000 + rng.randrange(40), 30_000 + rng.randrange(40)) for _ in range(30)]
    for links, least, most in (([], 1, 1), ([(7, 7)], 1, 1), (stars, 1, 1), ([(1, 2), (3, 2)], 2, 2), (stars + crossed, 2, 9)):
        tables.clear()
        of = {x: x for pair in links if pair[0] != pair[1] for x in pair}
        for _ in of:
            for a, b in links:
                if a != b:
                    of[a] = of[b] = min(of[a], of[b])
        rows = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(rows) == len(of) and {r.node: r.comp for r in rows} == of
        assert least <= len(tables) <= most


def test_jaccard_near_copies_reach_components_thinned(spark, monkeypatch):
    """Near copies that differ in up to three words each link with most others; components sees few of these links."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    seen = []
    plain = jaccard_join.components

    def counted(links):
        seen.append(links.count())
        return plain(links)

    monkeypatch.setattr(jaccard_join, "components", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(300):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {k: find(k) for k in range(300)}
    assert max(seen) < 3 * 300


def test_jaccard_near_copies_are_measured_few_times(spark, monkeypatch):
    """Near copies with one to fifteen words changed, without their base: some distances a class are measured, not a share of all pairs."""
    n, rng = 600, random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(min(15, 1 + int(rng.expovariate(1 / 3.5)))):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    seen = []
    plain = jaccard_join._measured

    def counted(pairs, *rest):
        out = plain(pairs, *rest)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_measured", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {k: find(k) for k in range(n)}
    assert n < sum(seen) < 8 * n, seen
