"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import per_text, small_batches, whole_text, words_of
from driftline.llm.folds import HELD_OUT, drawn, fold

#: Bounds of the training sample and of the model.
SAMPLE_EACH = 3_000
MAX_FEATURES = 4_000
GRADES = 4
MIN_DOCS = 5
PREFIXES = (3, 4, 5, 6)
STEPS, RATE, DECAY = 400, 0.05, 1e-3


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its first bytes, so that inflected forms share weight."""
    return [b"=" + word, *[b"^" + word[:n] for n in PREFIXES if len(word) >= n]]


@dataclass
class Ordinal:
    """P(grade > j) = sigmoid(w x - cut_j): one weight per feature for all cuts."""

    features: list[bytes]
    weights: np.ndarray
    length_weight: float
    cuts: np.ndarray

    def above(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(raw[:, None] - self.cuts[None, :], -30, 30)))


def _sparse(docs_counts: list[dict[int, int]]):
    rows = np.array([i for i, c in enumerate(docs_counts) for _ in c], np.int64)
    columns = np.array([f for c in docs_counts for f in c], np.int64)
    values = np.log1p(np.array([n for c in docs_counts for n in c.values()], np.float64))
    return rows, columns, values


def fit_ordinal(counts: list[dict[int, int]], lengths: np.ndarray, grades: np.ndarray,
                features: list[bytes], steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with weight decay by Adam; the cuts stay in order by construction."""
    n, top = len(grades), int(grades.max(initial=0))
    rows, columns, values = _sparse(counts)
    size = np.log1p(lengths) - np.log1p(lengths).mean()
    params = [np.zeros(len(features)), np.zeros(1), np.linspace(0, 1, max(top, 1))]
    params[2][1:] = 0.0  # the first cut, then logs of the steps between cuts
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, b, c = params
        cuts = c[0] + np.concatenate([[0], np.cumsum(np.exp(c[1:]))])
        raw = np.bincount(rows, values * w[columns], n) + b[0] * size
        up = 1 / (1 + np.exp(-np.clip(raw[:, None] - cuts, -30, 30)))
        edges = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = edges * (1 - edges)
        at = np.arange(n)
        p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-9)
        d_raw = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        d_cut = np.zeros((n, len(cuts) + 2))
        d_cut[at, grades] += slope[at, grades] / p / n
        d_cut[at, grades + 1] -= slope[at, grades + 1] / p / n
        d_cuts = d_cut[:, 1:-1].sum(axis=0)
        tail = np.cumsum(d_cuts[::-1])[::-1]
        grads = [np.bincount(columns, values * d_raw[rows], len(features)) + DECAY * w / 10,
                 np.array([d_raw @ size]) + DECAY * b,
                 np.concatenate([[tail[0]], tail[1:] * np.exp(c[1:])])]
        for x, a, s, g in zip(params, m, v, grads):
            a += 0.1 * (g - a)
            s += 0.001 * (g * g - s)
            x -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    w, b, c = params
    cuts = c[0] + np.concatenate([[0], np.cumsum(np.exp(c[1:]))])
    cuts = cuts + b[0] * np.log1p(lengths).mean()
    return Ordinal(features, w, float(b[0]), cuts)


def counter(features: list[bytes]):
    """A function of a text's bytes: number of words, counts by feature, words with a feature."""
    number = {f: i for i, f in enumerate(features)}
    heads = {f[1:4] for f in features}

    def count(data):
        words = words_of(data)
        counts: dict[int, int] = {}
        hit = 0
        for word in words:
            if word[:3] in heads:
                found = [number[f] for f in features_of(word) if f in number]
                hit += bool(found)
                for i in found:
                    counts[i] = counts.get(i, 0) + 1
        return len(words), counts, hit

    return count


def _sample(docs: DataFrame, labels: DataFrame, each: int, held_out: int | None) -> DataFrame | None:
    """id and class of at most ``each`` labelled ids of either class, by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null")
    if held_out is not None:
        known = known.where(fold("doc_id") != held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("__toxic") > 0).alias("t")).count().collect()}
    if len(counts) < 2:
        return None
    parts = [known.where((F.col("__toxic") > 0) == F.lit(t))
             .where(drawn("doc_id", min(1.0, 1.3 * each / n)))
             .orderBy(F.xxhash64("doc_id")).limit(each) for t, n in sorted(counts.items())]
    ids = parts[0].unionByName(parts[1]).collect()
    return docs.sparkSession.createDataFrame(ids, "doc_id long, __toxic int")


def select_features(rows: DataFrame) -> list[bytes]:
    """Features of toxic texts, by the lower bound of their log odds; counted on the executors."""
    def run(batches):
        for batch in batches:
            seen: dict[tuple[bytes, int], int] = {}
            for data, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in set(words_of(data)) for f in features_of(w)}:
                    seen[f, toxic] = seen.get((f, toxic), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.binary()), pa.array([k[1] for k in seen], pa.int32()),
                 pa.array(list(seen.values()), pa.int64())], names=["f", "toxic", "n"])

    total = {r[0]: r[1] for r in rows.groupBy("__toxic").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    counted = (rows.select("__text", "__toxic").mapInArrow(run, "f binary, toxic int, n long")
               .groupBy("f").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("c1"),
                                 F.sum(F.expr("if(toxic = 1, 0, n)")).alias("c0"))
               .where(F.col("c1") >= MIN_DOCS))
    odds = (F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
            - 2 * F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5)))
    best = counted.withColumn("odds", odds).where("odds > 0").orderBy(F.desc("odds"), "f")
    return [bytes(r["f"]) for r in best.limit(MAX_FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        each: int = SAMPLE_EACH, grades: int = GRADES,
        held_out: int | None = HELD_OUT) -> Ordinal | None:
    """The model of a bounded sample of labelled documents; None if a class is missing.

    Labels tell toxic from not; severity grades above 0 come from how large a share of a
    toxic text's words carries a selected feature, in equal parts of the sample.
    """
    small_batches(docs.sparkSession)
    ids = _sample(docs, labels, each, held_out)
    if ids is None:
        return None
    # at most 2 * each ids, so they may be broadcast
    rows = docs.select(F.col(id_column).alias("doc_id"),
                       whole_text(text_column).cast("binary").alias("__text")).join(
        F.broadcast(ids), "doc_id")
    features = select_features(rows)

    def run(batches):
        count = counter(features)
        for batch in batches:
            found = [count(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.int32()),
                 pa.array([f[2] for f in found], pa.int32()),
                 pa.array([list(f[1]) for f in found], pa.list_(pa.int32())),
                 pa.array([list(f[1].values()) for f in found], pa.list_(pa.int32()))],
                names=["toxic", "n", "hit", "f", "c"])

    told = (rows.select("__text", "__toxic")
            .mapInArrow(run, "toxic int, n int, hit int, f array<int>, c array<int>")
            # the bound holds where ids repeat in ``docs`` as well; a hash decides who stays
            .orderBy(F.xxhash64("f", "c", "n", "toxic"), "toxic", "n", "hit", "f", "c")
            .limit(4 * each).collect())
    told.sort(key=lambda r: (r["toxic"], r["n"], r["hit"], r["f"], r["c"]))
    if not told or not features:
        return None
    counts = [dict(zip(r["f"], r["c"])) for r in told]
    lengths = np.array([r["n"] for r in told], float)
    toxic = np.array([r["toxic"] > 0 for r in told])
    share = np.array([r["hit"] for r in told]) / np.maximum(lengths, 1)
    if toxic.all() or not toxic.any():
        return None
    cuts = np.quantile(share[toxic], [i / (grades - 1) for i in range(1, grades - 1)])
    level = np.where(toxic, 1 + (share[:, None] > cuts[None, :]).sum(axis=1), 0)
    return fit_ordinal(counts, lengths, level, features)


def predict(docs: DataFrame, model: Ordinal | None, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """id, toxic, grade, severity and p_toxic of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        known = shared.value
        if known is None:
            return lambda data: (False, 0, 0.0, 0.0)
        count = counter(known.features)

        def of(data):
            n, counts, _ = count(data)
            if not counts:  # no weight says anything, and length alone is no evidence
                return False, 0, 0.0, 0.0
            raw = known.length_weight * np.log1p(n) + sum(
                known.weights[i] * np.log1p(c) for i, c in counts.items())
            above = known.above(np.array([raw]))[0]
            p = np.concatenate([[1], above]) - np.concatenate([above, [0]])
            return bool(above[0] >= 0.5), int(p.argmax()), float(above.sum()), float(above[0])

        return of

    return per_text(docs, id_column, text_column, prepare, {
        "toxic": "boolean", "grade": "int", "severity": "double", "p_toxic": "double"})


def grade_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, toxic, grade (0 to 3), severity (expected grade), p_toxic.

    The model learns from at most SAMPLE_EACH labelled documents of either class outside
    the held-out fold. Null and empty texts, and texts without any feature of the model,
    get 0; so does every row when labels lack a class. Ids that repeat in ``labels`` count
    as toxic if any row says so. Repeated rows repeat their result; other columns are not
    looked at; an empty table gives no rows.
    """
    return predict(docs, fit(docs, labels, id_column, text_column), id_column, text_column)
