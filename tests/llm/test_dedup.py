"""Exact, near and substring deduplication against brute force."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, simhash, suffix_dedup
from driftline.llm.components import components


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


def exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact(odd):
    rows = odd.select("doc_id", "text").collect()
    assert rows_of(exact_dedup.exact_dedup(odd), *NAMES) == exact(rows)


def test_exact_compares_bytes_where_hashes_collide(odd):
    rows = odd.select("doc_id", "text").collect()
    weak = exact_dedup.exact_dedup(odd, hash_of=lambda t: F.length(t) % 2)
    assert rows_of(weak, *NAMES) == exact(rows)


def test_empty_tables(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def plain_fingerprint(text):
    lowered = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fingerprints, most=3):
    values = sorted(set(fingerprints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, v in enumerate(values):
        for w in values[i + 1:]:
            if (v ^ w).bit_count() <= most:
                root[max(find(v), find(w))] = min(find(v), find(w))
    return {v: find(v) for v in values}


def near(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    of = linked([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted(((i, f"{p:016x}", least.get(of[p])) for i, p in prints), key=repr)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near(which, request):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == near(rows)


def test_links_of_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_SPLIT_ABOVE", 8)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre}
    for _ in range(300):  # a chain of near copies, and far ones
        v = centre
        for b in rng.choice(64, rng.integers(1, 9), replace=False):
            v ^= 1 << int(b)
        values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in found}
    want = linked(values)
    groups = {}
    for v, r in want.items():
        groups.setdefault(r, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500 and 0 not in got


def test_one_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 6, 7, 8, 9, 10, 11] and ids.count(None) == 1


def cut_repeats(rows, n=suffix_dedup.LENGTH):
    key = lambda i: -1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            s = b[p:p + n]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < key(i):
                gone[p:p + n] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot_gram", [2, 5000])
def test_repeats_in_documents(documents, hot_gram):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = suffix_dedup.remove_repeats(documents, hot_gram=hot_gram)
    assert rows_of(got, *REMOVED) == cut_repeats(rows)


@pytest.mark.parametrize("hot_gram", [2, 5000])
def test_repeats_in_odd_texts(spark, odd, hot_gram):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 200))) for _ in range(40)]
    texts += ["ab" * 200, "ba" * 150, "a" * 500, "a" * 49, "a" * 50, "\x00" * 120, "é" * 60]
    rows = [(int(rng.integers(0, 30)), t) for t in texts] + [(None, "a" * 60), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, with_text=True, hot_gram=hot_gram)
    assert rows_of(got, *REMOVED) == cut_repeats(rows)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(suffix_dedup.remove_repeats(odd, hot_gram=hot_gram), *REMOVED) == cut_repeats(rows)


@pytest.mark.parametrize("hot_gram", [1, 3, 9, 100_000])
def test_crowded_grams_are_cut_by_offset(spark, monkeypatch, hot_gram):
    """One passage in many texts, with and without what stands around it, in many small pieces."""
    rng = np.random.default_rng(hot_gram)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    line = "this very passage stands on every page of the site"
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(0, 45)))
    rows = [(None if i % 9 == 4 else i // 2, word() + line[rng.integers(0, 3):][:rng.integers(20, 51)]
             + word() + line) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(docs, hot_gram=hot_gram)
    assert rows_of(got, *REMOVED) == cut_repeats(rows)


def test_cuts_of_a_gram():
    count = np.array([1, 10, 11, 20, 21, 40, 41, 10**9])
    assert suffix_dedup.cuts_of(count, 10).tolist() == [1, 1, 4, 4, 16, 16, 35, 35]


def test_long_texts_take_bounded_memory(spark):
    """A long text of one character, through all that its worker does with it."""
    size = 10 << 20
    batch = pa.RecordBatch.from_pydict({
        "d": [1], "tag": [0], "text": [b"x" * size], "cold": [[]], "hot": [[]], "cuts": [[]]})
    tracemalloc.start()
    runs, blobs = suffix_dedup.Runs(3), []
    for rows in suffix_dedup.chunks(iter([batch])):
        data, ends = suffix_dedup.laid_out(rows)
        found = suffix_dedup.anchors(data, ends)
        for made in runs.add(data, ends, rows, found, np.ones(len(found[0]), np.int32)):
            blobs += made.column("run").to_pylist()
    for made in runs.flush():
        blobs += made.column("run").to_pylist()
    ids, tags, place, step, number, mask = suffix_dedup.repeated(
        [suffix_dedup.Run(b) for b in blobs] + [suffix_dedup.Run(b) for b in _one_char(0)])
    assert ids.tolist().count(1) == len(ids) and number.sum() == size - 49 and len(ids) < 500
    n = suffix_dedup.without(b"x" * size, suffix_dedup.starts_of(place, step, number, mask))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n[:2] == (size, 1) and sum(map(len, blobs)) < 200_000
    assert peak < 250 << 20, peak


def _one_char(d):
    """The runs of a text of one character under another id."""
    runs = suffix_dedup.Runs(3)
    rows = [(d, 0, b"x" * 300, 0)]
    data, ends = suffix_dedup.laid_out(rows)
    found = suffix_dedup.anchors(data, ends)
    made = [*runs.add(data, ends, rows, found, np.ones(len(found[0]), np.int32)), *runs.flush()]
    return [b for batch in made for b in batch.column("run").to_pylist()]


def test_texts_without_ids_are_spread(spark):
    docs = spark.range(300).selectExpr(
        "cast(null as long) as doc_id", "concat(id, ' a line that stands in all of these texts, "
        "which have no id, and is long') as text")
    got = suffix_dedup.remove_repeats(docs)
    assert got.where("n_removed > 0 or doc_id is not null").count() == 0 and got.count() == 300


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), min_size=1, max_size=8), min_size=1, max_size=7))
def test_loser_tree_merges_and_knows_shared_prefixes(lists):
    runs = []
    for strings in lists:
        run = suffix_dedup.Run.__new__(suffix_dedup.Run)
        padded = sorted(s.ljust(suffix_dedup.LENGTH, b"\0") for s in strings)
        block = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, suffix_dedup.LENGTH)
        run.strings, run.shared = padded, suffix_dedup.shared_prefixes(block).tolist()
        runs.append(run)
    which, index, shared = suffix_dedup.merge(runs)
    merged = [runs[r].strings[i] for r, i in zip(which, index)]
    assert merged == sorted(s for r in runs for s in r.strings)
    block = np.frombuffer(b"".join(merged), np.uint8).reshape(-1, suffix_dedup.LENGTH)
    assert shared == suffix_dedup.shared_prefixes(block).tolist()


def test_runs_are_read_back(documents):
    rng = np.random.default_rng(1)
    n = 200
    right, left = rng.integers(16, 51, n), rng.integers(0, 35, n)
    after = rng.integers(97, 99, (n, 50)).astype(np.uint8)
    after[np.arange(50) >= right[:, None]] = 0
    before = rng.integers(97, 99, (n, 34)).astype(np.uint8)
    before[np.arange(34) >= left[:, None]] = 0
    order = np.argsort(suffix_dedup.as_bytes(after), kind="stable")
    ids = np.arange(n, dtype=np.int64)
    sizes = rng.integers(1, 4, n)
    members = [np.repeat(ids[order], sizes) for _ in range(5)]
    run = suffix_dedup.Run(suffix_dedup.front_coded(
        sizes, members, right[order], left[order], after[order], before[order]))
    assert (run.after == after[order]).all() and (run.before == before[order]).all()
    assert run.rank.tolist() == order.tolist() and run.sizes.tolist() == sizes.tolist()
    assert all((x == y).all() for x, y in zip(run.members, members))


def test_progressions():
    places = np.array([3, 4, 5, 9, 2, 4, 6, 8, 1, 7, 7])
    group = np.array([0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 3])
    ids = np.array([5, 5, 5, 5, 5, 5, 5, 5, 6, 6, 6])
    made = suffix_dedup.places_of(group, ids, ids, places)
    back = [(g, i, a + s * k) for g, i, _, a, s, n in zip(*(x.tolist() for x in made))
            for k in range(n)]
    assert back == list(zip(group.tolist(), ids.tolist(), places.tolist())) and len(made[0]) == 6
