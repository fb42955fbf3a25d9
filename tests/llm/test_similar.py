"""The near_dedup stage against brute force on five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import similar, stages


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_of(rows):
    """Lists of (id, text) that links of similarity 0.8 join."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
                root[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def kept_of(rows):
    return sorted(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups_of(rows))


def planted():
    """A text of 400 words and copies with more and more changed words, 0.75 to 0.99 alike."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for base in range(6):
        text = [word() for _ in range(400)]
        rows.append((100 * base, " ".join(text)))
        for k in range(1, 13):
            copy = list(text)
            for at in range(20, 20 + 30 * k, 30):
                copy[at] = word()
            rows.append((100 * base + k, " ".join(copy)))
    return rows + [(1000 + i, " ".join(word() for _ in range(60))) for i in range(30)]


@pytest.mark.parametrize("paired, block", [(2, 512), (12, 512), (2, 3)])
def test_planted_copies_are_found(spark, monkeypatch, paired, block):
    monkeypatch.setattr(similar, "PAIRED", paired)
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alike = [len(shingles(rows[0][1]) & shingles(t)) / len(shingles(rows[0][1]) | shingles(t))
             for _, t in rows[1:13]]
    assert sum(0.8 <= x < 0.95 for x in alike) >= 5 and min(alike) < 0.8
    got = sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == kept_of(rows)


def test_documents(spark, documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    kept = stages.near_dedup(spark, documents, "")
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == kept_of(rows)
    assert stages.near_dedup(spark, nothing, "").count() == 0


def test_bitmaps_part_no_pair_in_reach():
    rng = np.random.default_rng(2)
    sets = []
    for size in (1, 3, 9, 31, 33, 200, 1100):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        sets += [np.unique(base)]
        for share in (0.01, 0.05, 0.1, 0.12):
            sets.append(np.unique(np.concatenate([base[int(share * size):], rng.integers(
                0, 1 << 63, int(share * size / 2), np.uint64)])))
    parts = similar.parted(list(range(len(sets))), [len(s) for s in sets],
                           [similar.bitmap(s) for s in sets])
    part_of = {k: i for i, p in enumerate(parts) for k in p}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            if 10 * shared >= 8 * (len(a) + len(b) - shared):
                assert part_of[i] == part_of[j]


def test_one_text_of_each_group_stays_where_ids_repeat(spark, odd):
    copy, own = "one two three four five six seven", "quite another text that nobody else holds"
    rows = [(3, copy), (5, copy), (5, own), (9, "first of nine"), (9, "second of nine"),
            (None, copy), (None, "no id here"), (None, "no id here"), (7, ""), (8, None)]
    wide = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for docs, rows in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, wide)):
        kept = [(r.doc_id, r.text) for r in stages.near_dedup(spark, docs, "").select(
            "doc_id", "text").collect()]
        groups = groups_of(rows)
        assert len(kept) == len(groups)
        assert all(sum(k in g for k in kept) == 1 for g in groups)


def test_strays_meet_every_block(spark, monkeypatch):
    """A chain of near copies that no leader reaches whole, and texts that only share a line."""
    rng = random.Random(8)
    monkeypatch.setattr(similar, "BLOCK", 4)
    monkeypatch.setattr(similar, "LEADERS", 1)
    monkeypatch.setattr(similar, "PAIRED", 2)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    text, rows = [word() for _ in range(120)], []
    for i in range(40):  # each is some 0.9 like the one before, and far from the ones before that
        rows.append((i, " ".join(text)))
        text = text[:5 * i % 115] + [word()] + text[5 * i % 115 + 1:]
    line = [word() for _ in range(30)]
    rows += [(100 + i, " ".join(line + [word() for _ in range(rng.randrange(3, 40))])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == kept_of(rows) and got[0] == 0


def test_a_token_may_go_on_for_batches():
    rng = np.random.default_rng(1)
    token = np.repeat(np.array([3, 5, 9, 11]), [2, 300, 1, 4])
    key = rng.integers(0, 1000, len(token))
    place = np.full(len(token), 40, np.int64)
    def edges(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i:i + size]) for x in (token, key, place)],
                                              names=["token", "key", "place"])
                   for i in range(0, len(token), size)]
        return [r for b in similar._met(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    whole = edges(1000)
    many = {k for a, b, m in whole if m for k in (a, b)}
    assert many == set(key[2:302].tolist())
    for size in (1, 7, 50):
        part = edges(size)
        assert {k for a, b, m in part if m for k in (a, b)} == many
        assert {x for x in part if not x[2]} == {x for x in whole if not x[2]}
