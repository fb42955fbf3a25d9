"""Row-by-row operators against plain versions and held-out rows."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontaminate, language, licenses, pii, toxicity
from driftline.llm.folds import HELD_OUT, fold

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


# --- benchmark decontamination

def contamination(rows, items):
    windows = []
    for i, t in items:
        w = WORD.findall(lowered(t))
        if i is not None and w:
            n = min(13, len(w))
            windows += [(str(i), w[k:k + n]) for k in range(len(w) - n + 1)]
    out = []
    for i, t in rows:
        w = WORD.findall(lowered(t))
        hit, found = set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k:k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(item)
        out.append((i, len(w), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


FOUND = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontaminate(odd, benchmark, bound):
    docs = odd.where("doc_id is null or doc_id not in (6, 7)")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    got = decontaminate.decontaminate(docs, benchmark, max_broadcast_bytes=bound)
    assert rows_of(got, *FOUND) == contamination(rows, items)
    marked = decontaminate.annotate(docs, benchmark, "__c", max_broadcast_bytes=bound)
    assert marked.columns == [*docs.columns, "__c"]
    assert rows_of(marked, "doc_id", "__c") == sorted(
        ((r[0], r[5]) for r in contamination(rows, items)), key=repr)


def test_cleaned_text(spark, benchmark):
    docs = spark.createDataFrame([(1, "Keep, brown-Fox! and (lazy dog) this"), (2, None)],
                                 "doc_id long, text string")
    got = {r.doc_id: r.cleaned_text for r in decontaminate.decontaminate(
        docs, benchmark, with_text=True).collect()}
    assert got == {1: "Keep, -! and ( ) this", 2: None}


def test_empty_tables(nothing, benchmark, odd):
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    none = decontaminate.decontaminate(odd, benchmark.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == odd.count()
    assert licenses.scan_licenses(nothing).count() == 0
    assert pii.pii_report(nothing).count() == 0
    assert language.identify(nothing).count() == 0
    assert toxicity.grade_toxicity(nothing, nothing.selectExpr(
        "doc_id", "1 as quality", "1 as toxic")).count() == 0


# --- licences

def places(text):
    w, starts, labels = WORD.findall(lowered(text)), [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        for k in range(len(w)):
            if w[k:k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)))


def test_license_places(spark, odd, documents):
    more = spark.createDataFrame([
        (50, "mit license mit license. GNU General Public-License cc by cc by nc"),
        (51, "the gnu general public license apache license mit license; CC\nBY 4.0"),
        (52, "cc\x00by"), (53, "gnu general public")], "doc_id long, text string")
    for docs in (odd, documents, more):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = licenses.scan_licenses(docs)
        assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") \
            == sorted(((i, *places(t)) for i, t in rows), key=repr)
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert 0 <= r.score <= 1


def test_tags(spark):
    docs = spark.createDataFrame([
        (1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"),
        (2, "# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0\nx"),
        (3, "SPDX-License-Identifier: MIT AND"), (4, "SPDX-License-Identifier: GPL-2.0 or (MIT)")],
        "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.permissive, r.score) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("apache-2.0,bsd-3-clause,mit", True, 1.0), 2: ("gpl-2.0-only", False, 1.0),
                   3: ("", False, 0.3), 4: ("gpl-2.0,mit", True, 1.0)}


def test_shunting_yard():
    assert licenses.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.to_postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    for bad in ("", "a b", "and a", "(a", "a)", "a or", "()"):
        assert licenses.to_postfix(bad) is None


# --- personal data

def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    text, found = text or "", []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                  "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                found.append((m.start(), order, m.end(), kind))
    return sorted(found)


PII_TEXTS = [
    "mail a.b@c.de, x@y x@y.z.w_q@r.st! 1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1 256.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4 1",
    "call +1 (017) 555-7713 or +49 30 1234567890123456 +1+2 +12 345 678 90. é +44 20 7946 0958é",
    "\U0001f600 a@b.co 　 IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 x",
    "a@b.c@d.e.f@g", "@@@", "...1.1.1.1...", "1" * 5000, "a" * 50_000, "a." * 20_000 + "@b.c",
    "+1" * 3000, "1 " * 4000, "5-" * 3000, "u@" + "a." * 5000 + "b", None, ""]


def test_pii(spark, odd, documents):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(PII_TEXTS)], "doc_id long, text string")
    for docs in (texts, odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, t in rows:
            spans = base_spans(t)
            text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
            n = [sum(x[3] == k for x in spans) for k in pii.BASE_KINDS]
            want.append((i, *n, hashlib.sha256(text.encode()).hexdigest()))
        got = pii.pii_report(docs)
        assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") \
            == sorted(want, key=repr)
    spans = {r.doc_id: r.spans for r in pii.pii_report(texts).collect()}
    text = PII_TEXTS[3]
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"):
        at = text.index(iban)
        assert f"iban:{at}:{at + len(iban)}" in spans[3]
    scored = {s.kind: s.score for r in pii.find_pii(spark.createDataFrame(
        [(1, "please call +1 (017) 555-7713"), ], "doc_id long, text string")).collect() for s in r.spans}
    assert scored["phone"] > 0.6


def test_many_matches_in_one_text(spark):
    """The work grows with the matches: a text of 100,000 addresses and cards."""
    n = 100_000
    text = " ".join(f"u{i}@h{i % 997}.org" if i % 10 else "4111-1111-1111-1111" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text[:40])], "doc_id long, text string")
    began = time.perf_counter()
    got = pii.pii_report(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert time.perf_counter() - began < 60
    spans = base_spans(text)
    want = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    assert (rows[1].n_email, rows[1].n_card) == (90_000, 10_000) and rows[2].n_card == 1
    assert rows[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [1, 2, 3])
def test_parts_of_matches_join(spark, monkeypatch, part):
    monkeypatch.setattr(pii, "PART_MATCHES", part)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        [" ".join(f"x{k}@y.z" for k in range(n)) + " 1.2.3.4" for n in range(8)])],
        "doc_id long, text string")
    for r, (_, t) in zip(sorted(pii.pii_report(docs).collect()), sorted(map(tuple, docs.collect()))):
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(t))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


# --- language

def plain_network(net, data):
    """Probabilities of one window, filter by filter and place by place."""
    x = [net.embed[b].astype(float) for b in data]
    x += [net.embed[32].astype(float)] * (max(language.WIDTHS) - 1)
    pooled = []
    for k, weight, bias in zip(language.WIDTHS, net.filters, net.biases):
        for f in range(weight.shape[1]):
            best = max(float(np.concatenate(x[i:i + k]) @ weight[:, f]) for i in range(len(data)))
            pooled.append(max(best + float(bias[f]), 0.0))
    logits = np.array(pooled) @ net.dense + net.offset
    e = np.exp(logits - logits.max())
    return e / e.sum()


def test_classification_is_that_of_a_plain_network(documents):
    net = language.fit(documents)
    texts = [r.text.encode() for r in documents.where("text is not null").limit(4).collect()]
    texts += [b"a", b"abc", texts[0][:256], texts[0][:257], "für été ñ".encode()]
    for data in texts:
        data = data[:900]
        windows, lengths = language.windows_of(data)
        total = sum(n * plain_network(net, w) for w, n in zip(windows, lengths)) / lengths.sum()
        lang, score = language.classify(net, data, most=3)
        assert lang == net.languages[int(total.argmax())] and score == pytest.approx(
            total.max(), abs=1e-4)


def test_noise_is_no_language(documents):
    net = language.fit(documents, noise=True)
    texts = [r.text.encode() for r in documents.where("length(text) > 300").limit(40).collect()]
    assert sum(language.classify(net, t)[0] == "und" for t in texts) <= 1
    noise = language.noise_windows([t[:256] for t in texts], 40, seed=99)
    assert sum(language.classify(net, t)[0] == "und" for t in noise) >= 38


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"])
    windows, labels = rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        pooled, _, _ = net.pooled(windows)
        p = language.softmax((pooled @ net.dense + net.offset).astype(np.float64))
        return -np.log(p[np.arange(5), labels]).mean()

    grads = net.gradients(windows, labels)
    for param, grad in zip(net.parameters(), grads):
        flat, g = param.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            kept, eps = flat[i], 1e-2
            flat[i] = kept + eps
            up = loss()
            flat[i] = kept - eps
            down = loss()
            flat[i] = kept
            assert abs((up - down) / (2 * eps) - g[i]) < 0.1 * abs(g[i]) + 2e-3


def test_windows_cover_every_byte():
    for n in (1, 3, 4, 255, 256, 257, 1000, 5061):
        data = bytes(1 + i % 250 for i in range(n))
        windows, lengths = language.windows_of(data)
        step = language.WINDOW - max(language.WIDTHS) + 1
        for k in range(n - 3):  # every four-byte string lies whole in some window
            w = min(k // step, len(windows) - 1)
            assert windows[w][k - w * step:k - w * step + 4].tobytes() == data[k:k + 4]
        assert (lengths > 0).all()


def test_language_of_held_out_rows(documents, odd, spark):
    docs = documents.unionByName(odd.select(*documents.columns))
    found = language.identify(docs)
    assert found.count() == docs.count()
    joined = found.join(documents.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = joined.where("held_out and n > 100").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) > 20
    told = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd).collect()
            if r.doc_id in (3, 4, 5, 10)}
    assert told == {(i, "und", 0.0) for i in (3, 4, 5, 10)}
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(bare).collect()} == {"und"}


# --- toxicity

def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.grade_toxicity(docs, labels)
    assert found.count() == docs.count()
    held = (found.withColumnRenamed("toxic", "said").join(labels, "doc_id")
            .where(fold("doc_id") == HELD_OUT).collect())
    clean = [r for r in held if not r.toxic]
    assert sum(not r.said for r in clean) >= 0.97 * len(clean)
    toxic = [r for r in held if r.toxic]
    assert sum(r.said for r in toxic) >= 0.5 * len(toxic) > 0
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in found.collect())


def test_severity_is_that_of_a_plain_model(documents, odd):
    """Grades from the weights, word by word."""
    model = toxicity.Ordinal([b"=fox", b"^qui", b"=the", b"^laz"], np.array([1.5, -0.5, 0.7, 2.0]), 0.3,
                             np.array([0.5, 1.5, 3.0]))
    for docs in (odd, documents):
        got = {(r.doc_id, round(r.severity, 6), r.grade, r.toxic) for r in toxicity.predict(
            docs, model).collect()}
        want = set()
        for r in docs.select("doc_id", "text").collect():
            words = [w.encode() for w in WORD.findall(lowered(r.text))]
            raw, some = model.length_weight * math.log1p(len(words)), False
            for f, w in zip(model.features, model.weights):
                n = sum(x == f[1:] if f[:1] == b"=" else x[:3] == f[1:] for x in words)
                raw, some = raw + w * math.log1p(n), some or n > 0
            up = [1 / (1 + math.exp(-(raw - c))) for c in model.cuts] if some else [0.0] * 3
            p = [a - b for a, b in zip([1, *up], [*up, 0])]
            want.add((r.doc_id, round(sum(up), 6), p.index(max(p)), up[0] >= 0.5))
        assert got == want


def test_toxicity_without_a_class(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.grade_toxicity(odd, labels)
    assert got.count() == odd.count() and got.where("toxic or severity > 0").count() == 0


def test_ordinal_weights_order_the_grades():
    rng = np.random.default_rng(2)
    level = rng.integers(0, 4, 600)
    counts = [({0: int(k)} if k else {}) | {1: int(rng.integers(1, 4))} for k in level]
    model = toxicity.fit_ordinal(counts, rng.integers(20, 200, 600).astype(float), level, [b"=x", b"=y"])
    assert model.weights[0] > 5 * abs(model.weights[1]) and (np.diff(model.cuts) > 0).all()
