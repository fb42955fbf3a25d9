"""Mixing, packing and the pipeline: brute force, round trips and the stages' decisions."""

import re

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import decontaminate, language, mixing, packing, stages
from driftline.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_mix_takes_targets_and_no_document_thrice(odd, documents, nothing):
    for docs in (odd, documents):
        got = mixing.mix_report(docs).collect()
        assert len(got) == docs.count()
        texts = [(r.source, r.text) for r in docs.select("source", "text").collect()]
        sizes = {}
        for source, text in texts:
            sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        target, open_ = {}, set(order)
        left = 1.5 * sum(sizes.values())
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
            if not full:
                target |= {s: weight[s] * level for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in full}
            left -= sum(2 * sizes[s] for s in full)
            open_ -= full
        assert sorted(r.size for r in got) == sorted(
            len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in texts)
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        total = {}
        for r in got:
            total[r.source_size, round(r.target, 3)] = total.get((r.source_size, round(r.target, 3)), 0) + r.taken
        same = {}
        for s in order:
            key = (sizes[s], round(target[s], 3))
            same[key] = same.get(key, 0) + int(target[s] + 0.5)
        assert total == same
    assert mixing.mix_report(nothing).count() == 0


def test_mixed_documents_hold_the_taken_words(odd, documents):
    for docs in (odd, documents):
        taken = {}
        for r in mixing.mix_report(docs).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        mixed = mixing.mix_documents(docs)
        assert mixed.columns == docs.columns
        words, whole = {}, {}
        for r in docs.select("doc_id", "text").collect():
            whole.setdefault(r.doc_id, []).append(r.text or "")
        for r in mixed.select("doc_id", "text", "n_chars").collect():
            words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
            assert any(t.startswith(r.text) for t in whole[r.doc_id]) and r.n_chars == len(r.text)
        assert words == {k: v for k, v in taken.items() if v}


def test_slots_are_low_discrepancy(documents):
    mix = mixing.Mix(documents, block_words=16)
    slots = [r["rank"] for r in mix._slots().orderBy("slot").collect()]
    share = {r["rank"]: r["slots"] for r in mix.sources.collect()}
    n = sum(share.values())
    for rank, count in share.items():
        seen = np.cumsum(np.array(slots[:n]) == rank)
        assert np.abs(seen - np.arange(1, n + 1) * count / n).max() < 6


def test_encoder_agrees_with_the_tokenizer(documents):
    ranks = packing.read_ranks(documents.sparkSession, packing.TOKENIZER)
    plain = tiktoken.Encoding("x", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = packing.Encoder(ranks)
    texts = [r.text for r in documents.select("text").limit(60).collect()]
    texts += ["", " ", "  a", "a  b", "a \n b\n\n c ", "\n x", "it's  'll", "é　b \x1c c", " \t\tq r",
              "x" * 500 + " " + "y z" * 50, "a b \n"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), np.uint16).tolist() == plain.encode_ordinary(text)


def test_packed_rows_are_read_back(odd, documents, nothing, spark):
    ranks = packing.read_ranks(spark, packing.TOKENIZER)
    names = {v: k for k, v in ranks.items()}
    for docs, size in ((documents, 512), (odd.where("doc_id is not null and doc_id <> 9"), 128)):
        texts = {}
        for r in packing.pack(docs, sequence=size, shard_bytes=1 << 16).collect():
            ids = np.frombuffer(bytes(r.ids), np.uint16)
            assert len(ids) == size and (ids[r.n_tokens:] == 50256).all()
            assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == r.n_segments
            for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
                assert (d, p) not in texts
                texts[d, p] = b"".join(names[int(x)] for x in ids[a:b])
        whole = {}
        for (d, _), t in sorted(texts.items()):
            whole[d] = whole.get(d, b"") + t
        want = {r.doc_id: r.text.encode() for r in docs.select("doc_id", "text").collect() if r.text}
        assert whole == want
    assert packing.pack(nothing).count() == 0
    twice = packing.pack(odd.where("doc_id = 9"), sequence=128).collect()
    assert sorted(d for r in twice for d in r.doc_ids) == [9, 9, 9]


def test_best_fit_decreasing_by_hand():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 33, rng.integers(1, 60)).tolist()
        rows, left = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [x for x in left if x >= sizes[i]]
            best = min(fits, default=None)
            if best is None:
                left.append(32 - sizes[i])
                rows.append([sizes[i]])
            else:
                k = left.index(best)
                left[k] -= sizes[i]
                rows[k].append(sizes[i])
        got = [[sizes[i] for i in r] for r in packing.best_fit_decreasing(sizes, 32)]
        assert sorted(i for r in packing.best_fit_decreasing(sizes, 32) for i in r) == list(range(len(sizes)))
        assert sorted(map(sum, got)) == sorted(map(sum, rows)) and max(map(sum, got)) <= 32


def one_of_each(rows):
    """The smallest id of each group of texts whose five-word shingles agree in four fifths."""
    sets, least = {}, {}
    for r in rows:
        words = r.text.encode().lower().split()
        own = frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else \
            frozenset()
        sets.setdefault(own, []).append(r.doc_id)
    keys = list(sets)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i + 1, len(keys)):
            shared = len(a & keys[j])
            if shared and 5 * shared >= 4 * (len(a) + len(keys[j]) - shared):
                root[find(j)] = find(i)
    for i, a in enumerate(keys):
        least[find(i)] = min([*sets[a], least.get(find(i), sets[a][0])])
    return set(least.values())


def test_the_network_decides(spark, documents, monkeypatch):
    """Another network, another result; what is no language goes, labels that lack are filled."""
    junk = [(10**6 + i, "".join(np.random.default_rng(i).choice(list(
        "abcdefghijklmnopqrstuvwxyz0123456789{}[]<>$#@ "), 900))) for i in range(8)]
    docs = documents.unionByName(spark.createDataFrame(junk, "doc_id long, text string"),
                                 allowMissingColumns=True)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    known = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    kept = {r.doc_id: r.lang for r in stages.language_id(spark, docs, "").collect()}
    assert not [d for d in kept if d >= 10**6]
    filled = [kept[d] == known[d] for d in kept if d % 5 == 0 and known[d]]
    assert len(filled) > 20 and np.mean(filled) > 0.95
    real = language.fit

    def other(*args, **options):
        net = real(*args, **options)
        net.offset[net.languages.index("und")] += 1000
        return net

    monkeypatch.setattr(language, "fit", other)
    assert stages.language_id(spark, docs, "").count() == 0


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SMALL).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames[:5]]
    net = language.fit(frames[0], noise=True)
    found = {r.doc_id: r for r in language.predict(frames[0], net).collect()}
    assert ids[1] == {d for d, r in found.items()
                      if r.lang_pred != "und" or 0 < r.score < stages.NO_LANGUAGE}
    found = {d: None if r.lang_pred == "und" else r.lang_pred for d, r in found.items()}
    labelled = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {r.doc_id: r.lang for r in frames[1].select("doc_id", "lang").collect()} == {
        d: labelled[d] or found[d] for d in ids[1]}
    assert ids[2] == one_of_each(frames[1].select("doc_id", "text").collect())
    found = decontaminate.decontaminate(frames[2], table(spark, SMALL, "benchmark")).collect()
    assert ids[3] == {r.doc_id for r in found if not r.contaminated}
    taken = {r.doc_id for r in mixing.mix_report(frames[3]).collect() if r.taken}
    assert ids[4] == taken
    assert all(f.columns == docs.columns for f in frames[:5])
    packed = {d for r in frames[5].collect() for d in r.doc_ids}
    assert packed == {r.doc_id for r in frames[4].where("length(text) > 0").collect()}
    assert frames[1].select(F.count("text")).first()[0] == len(ids[1])


def test_repeated_rows_are_dealt_on(spark):
    """Copies of one row fill no shard, and all of them are packed."""
    docs = spark.range(4000).selectExpr("1L as doc_id", "'some words that repeat' as text").repartition(16)
    rows = packing.pack(docs, sequence=64, shard_bytes=1 << 12).collect()
    shards = {}
    for r in rows:
        shards[r.shard] = shards.get(r.shard, 0) + r.n_segments
    assert sum(shards.values()) == 4000 and len(shards) >= 8 and max(shards.values()) <= 1000


def test_many_short_texts_are_dealt_on(spark):
    """Texts of one byte each fill no shard, and all of them are packed."""
    docs = spark.range(4000).selectExpr("id as doc_id", "char(97 + id % 26) as text")
    rows = packing.pack(docs, sequence=64, shard_bytes=1 << 12).collect()
    shards = {}
    for r in rows:
        shards[r.shard] = shards.get(r.shard, 0) + r.n_segments
    assert sorted(d for r in rows for d in r.doc_ids) == list(range(4000))
    assert len(shards) >= 32 and max(shards.values()) <= 200
    blank = docs.selectExpr("doc_id", "if(doc_id % 2 = 0, '', null) as text")
    assert packing.pack(blank, shard_bytes=1).count() == 0
