"""Each stage of the pipeline against plain Python, on what the stage before kept."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from contrail.llm import line_dedup, quality_rules
from contrail.llm.shared import stored

from .test_contracts import WORD, base_figures, expected_join, hold_packing, word_ids
from .test_other import expected_lines


def normal(line):
    return " ".join(re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(line))


def expected_quality(docs):
    """doc_id -> text of the kept documents, without lines that too many documents of the host have."""
    hosts, seen = Counter(r.source for r in docs), Counter()
    for r in docs:
        seen.update({(r.source, n) for line in (r.text or "").split("\n") if (n := normal(line))})
    q = quality_rules

    def frequent(host, line):
        n, size = seen[host, line], hosts[host]
        many = n >= q.MIN_DOCS and n > q.SHARE * size
        few = size < q.MIN_DOCS and n >= q.SMALL_DOCS and n > q.SMALL_SHARE * size
        return bool(line) and (n >= q.MOST_DOCS or many or few)

    out = {}
    for r in docs:
        base = base_figures(r.text)
        if r.text is None or base[0] < 10 or 100 * base[4] > 20 * base[0]:
            continue
        kept = [line for line in r.text.split("\n") if not frequent(r.source, normal(line))]
        if sum(len(WORD.findall(x)) for x in kept) >= q.KEEP_WORDS * base[0]:
            out[r.doc_id] = "\n".join(kept)
    return out


def expected_languages(docs):
    """doc_id -> language by symbol-by-symbol escape probabilities, trained on the documents that are not held out."""
    prepared = {r.doc_id: b"\n\n\n" + re.sub(b"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()) for r in docs}
    trees = defaultdict(lambda: [defaultdict(Counter) for _ in range(4)])
    for r in docs:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 and len(r.text.encode()) <= 20_000:
            raw = prepared[r.doc_id]
            for i in range(3, len(raw)):
                for order in range(4):
                    trees[r.lang][order][raw[i - order : i]][raw[i]] += 1
    known = {}

    def bits(lang, context, byte):
        if (lang, context, byte) not in known:
            p = 1 / 256
            lower = dict.fromkeys(range(256), p)
            for order in range(4):
                c = trees[lang][order].get(context[3 - order :])
                if c:
                    total, kinds = sum(c.values()), len(c)
                    spare = sum(q for b, q in lower.items() if b not in c)
                    lower = {b: c[b] / (total + kinds) if b in c else kinds / (total + kinds) * lower[b] / spare for b in lower}
            for b, q in lower.items():
                known[lang, context, b] = -math.log2(q)
        return known[lang, context, byte]

    out = {}
    for r in docs:
        raw = prepared[r.doc_id]
        total = {lang: sum(bits(lang, raw[i - 3 : i], raw[i]) for i in range(3, len(raw))) for lang in trees}
        best = min(sorted(total), key=total.get)
        share = 1 / sum(2.0 ** max(-1000, total[best] - x) for x in total.values())
        if any(c.isalpha() for c in r.text or "") and share >= 0.5:
            out[r.doc_id] = best
    return out


def expected_line_stage(docs):
    want = {r.doc_id: (r.text or "").split("\n") for r in docs}
    for d, i, _, head, at in expected_lines([(k, r.doc_id, r.text) for k, r in enumerate(docs)]):
        if (d, i) != (head, at):
            want[d][i] = None
    text = {d: "\n".join(x for x in lines if x is not None) for d, lines in want.items()}
    return {d: t for d, t in text.items() if WORD.search(t)}


def test_stages(spark, sf, monkeypatch):
    monkeypatch.setattr(line_dedup, "INDEX_BITS", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "jaccard_join", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.orderBy("doc_id").collect()
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == docs.count()
        texts = {d: r.text for d, r in got.items()}
        if name == "quality_rules":
            assert texts == expected_quality(before)
        elif name == "language_id":
            assert {d: r.lang for d, r in got.items()} == expected_languages(before)
            assert texts == {r.doc_id: r.text for r in before if r.doc_id in got}
        elif name == "line_dedup":
            assert texts == expected_line_stage(before)
        else:
            join = expected_join([(r.doc_id, r.text) for r in before])
            assert set(got) == {d for d, _, component in join if d == component}
            assert texts == {r.doc_id: r.text for r in before if r.doc_id in got}
        assert all(r.n_chars == len(r.text) for r in got.values() if name in ("quality_rules", "line_dedup"))
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert hold_packing(packed, word_ids({r.doc_id: r.text for r in docs.collect()})) >= 0


def test_run_is_the_stages_one_after_the_other(spark, sf, monkeypatch):
    """run() hands each stage what the one before wrote; here with stages that leave marks."""
    mark = lambda n: lambda s, docs, d: docs.selectExpr("doc_id", f"concat(text, '{n}') AS text", "lang", "source", "n_chars")
    monkeypatch.setattr(pipeline, "STAGES", [("a", mark("a")), ("b", mark("b")), ("c", lambda s, docs, d: docs.select("doc_id", "text"))])
    assert all(r.text.endswith("ab") for r in pipeline.run(spark, sf).filter("text IS NOT NULL").collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "x", "en", "s", 1), (1, "x", "en", "s", 1)]])
def test_stages_on_odd_tables(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
