import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from driftline.llm import divergence, filter_audit
from driftline.llm import transducer as T

WORDS, SYMBOLS = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[#$%&*|]")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_counts(data):
    words = WORDS.findall(data)
    return [len(words), len(set(words)), len(re.findall(rb"[A-Z]", data)),
            len(data.decode()), len(SYMBOLS.findall(data))]


def test_transducer_counts_as_plain_python(documents):
    texts = [(r.text or "").encode() for r in documents.select("text").collect()]
    texts += [b"", b" ", b"\x00", b"a", b"a a", b"A\x0bb\x0cA", "äÖ \U0001f600 　x".encode(),
              b"w" * 500 + b" " + b"w" * 500 + b" " + b"w" * 499, b"ab " * 5000, b"#$%&*|"]
    assert T.Transducer().run(texts).tolist() == [plain_counts(t) for t in texts]
    assert T.Transducer().run([]).tolist() == []


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_words_cross_blocks(monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    texts = [b"one two  one", b"", b"two", b" " + b"long" * 60 + b" x", b"long" * 60]
    assert T.Transducer().run(texts).tolist() == [plain_counts(t) for t in texts]


def test_equal_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(T.WordTable, "hashes", lambda self, row, start, length: np.full(
        len(row), 5, np.uint64))
    texts = [b"a b a c", b"a b", b"bb b bb " + b"y" * 300 + b" " + b"y" * 299 + b"z"]
    assert T.Transducer().run(texts).tolist() == [plain_counts(t) for t in texts]


def brute_audit(docs, labels):
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None}
                   for c in ("quality", "toxic"))
    least = {}
    for r in docs:
        if r.doc_id is not None:
            text = r.text or ""
            least[text] = min(least.get(text, r.doc_id), r.doc_id)
    parts = defaultdict(list)
    for r in docs:
        text = r.text or ""
        words, distinct, capitals, points, symbols = plain_counts(text.encode())
        failed = {x for x, bad in (("A", words < 200), ("B", 100 * distinct < 50 * words),
                                   ("C", 100 * capitals > 2 * points), ("D", symbols > 0),
                                   ("E", r.doc_id is not None and least[text] < r.doc_id)) if bad}
        parts[r.source or ""].append((failed, r.doc_id in good, r.doc_id in toxic))
    rows, shapley = {}, Counter()
    for part, found in parts.items():
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                gone = [bool(f & set(order[:step - 1])) for f, _, _ in found]
                here = [own in f and not g for (f, _, _), g in zip(found, gone)]
                shapley[part, own] += sum(here)
                rows[part, order, step] = [
                    sum(not g and not h for g, h in zip(gone, here)), sum(here),
                    sum(g and own in f for g, (f, _, _) in zip(gone, found)),
                    sum(f == {own} for f, _, _ in found),
                    sum(h and x[1] for h, x in zip(here, found)),
                    sum(h and x[2] for h, x in zip(here, found))]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (9, 0, 1), (None, 1, 1), (7, 1, 0), (99, 1, 1)]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_audit_by_hand(spark, odd, documents, which):
    docs = odd if which == "odd" else documents
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int") \
        if which == "odd" else spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = filter_audit.audit_filters(docs, labels).collect()
    want = brute_audit(docs.select("doc_id", "text", "source").collect(), labels.collect())
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == want and len(got) == len(want)


def test_audit_of_nothing(spark, odd, nothing):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(nothing, labels).count() == 0
    assert filter_audit.audit_filters(odd, labels.where("false")).count() == 3 * 600 + 600


def test_copies_without_ids_are_spread(spark):
    docs = spark.range(6000).selectExpr(
        "if(id % 3 = 0, null, id) doc_id", "'same text' text", "'s' source")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    row = filter_audit.audit_filters(docs, labels).where(
        "filter_order = 'EABCD' and step = 1").first()
    assert (row.kept, row.removed, row.unique_fails) == (2001, 3999, 0)


def brute_divergence(docs, least):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        lang, source, text = r.lang or "", r.source or "", r.text or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = TERMS.findall(lower)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang in {k for k, _ in counts}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        groups = sorted(s for k, s in counts if k == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in groups}

        def share(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        p = {s: [share(counts[lang, s][t], n[s]) for t in kept] for s in groups}
        q = [share(sum(counts[lang, s][t] for s in groups), sum(n.values())) for t in kept]
        for s in groups:
            pairs = [(-sum((a - b)**2 // (a + b) for a, b in zip(p[s], p[o])), o)
                     for o in groups if o != s]
            terms = [(-((a - b)**2 // (a + b)), t) for a, b, t in zip(p[s], q, kept)
                     if counts[lang, s][t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(
                    terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(items, 1)}
    return out


@pytest.mark.parametrize("cells, held", [(500_000, 200_000), (40, 50)])
def test_divergence_by_hand(spark, odd, documents, monkeypatch, cells, held):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "HELD", held)
    for docs, least in ((documents, 10), (odd, 2), (odd, 1)):
        got = divergence.audit_sources(docs, least=least).collect()
        want = brute_divergence(docs.select("lang", "source", "text").collect(), least)
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_divergence_of_nothing(nothing):
    assert divergence.audit_sources(nothing).count() == 0


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 3, 10**12, 10**14 + 7], np.int64)
    total = 2 * 10**14 + 13
    assert divergence.shares(counts, total).tolist() == [
        1 + 10**9 * int(c) // total for c in counts]
