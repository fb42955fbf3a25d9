"""Benchmark decontamination: words of training texts that stand in benchmark windows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import (WORD_BYTES, per_text, pieces_of, small_batches, with_answer,
                                  words_of)

WINDOW = 13
#: Bytes of benchmark text that may be broadcast; a larger benchmark is joined instead.
MAX_BROADCAST_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = 0x9E3779B97F4A7C15
#: Bits of the filter that windows of texts pass before a join (16 MB), and its parts.
FILTER_BITS, _FILTER_CHUNKS = 1 << 27, 256


def item_windows(items, window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Windows of the benchmark and the ids of the items that hold each."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        if item_id is None:
            continue
        words = words_of(text.encode() if isinstance(text, str) else text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(tuple(words[i:i + size]), set()).add(str(item_id))
    return {k: sorted(v) for k, v in found.items()}


class WindowSet:
    """The benchmark's windows as a hash set, with the word numbers the hashes are made of."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.numbers: dict[bytes, int] = {}
        self.windows = windows
        self.hashes: dict[int, np.ndarray] = {}
        by_size: dict[int, list] = {}
        for words in windows:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            by_size.setdefault(len(words), []).append(ids)
        for size, rows in by_size.items():
            self.hashes[size] = np.unique(self.rolled(np.array(rows, np.uint64).T))

    @staticmethod
    def rolled(columns: np.ndarray) -> np.ndarray:
        """One hash per column of word numbers."""
        out = np.zeros(columns.shape[1], np.uint64)
        for row in columns:
            out = (out + row) * np.uint64(_MIX)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words stand in a window, and the items of the windows that occur."""
        n = len(words)
        hit, items = np.zeros(n + 1, np.int32), set()
        number = self.numbers.get
        known = np.array([number(w, 0) for w in words], np.uint64)
        before = np.concatenate([[0], np.cumsum(known > 0)])
        for size, hashes in self.hashes.items():
            if n < size:
                continue
            starts = np.flatnonzero(before[size:] - before[:-size] == size)
            if not len(starts):
                continue
            rolled = self.rolled(known[starts + np.arange(size)[:, None]])
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for i in starts[hashes[at] == rolled].tolist():
                ids = self.windows.get(tuple(words[i:i + size]))  # the words themselves decide
                if ids:
                    items.update(ids)
                    hit[i] += 1
                    hit[i + size] -= 1
        return np.cumsum(hit[:n]) > 0, items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_FIELDS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string",
           "contaminated": "boolean", "cleaned_text": "string"}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  id_column: str = "doc_id", text_column: str = "text",
                  with_text: bool = False,
                  max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it stands inside an occurrence of a benchmark window; an item of
    fewer words than ``window`` is one window, an item without words is none. A document
    is contaminated when at least one in twenty of its words is hit. Null texts and null
    items have no words; rows of the benchmark without an id are left out, rows that
    repeat an id add their windows to it. ``with_text`` adds cleaned_text, the text
    without its hit words' spans (null for a null text).

    The benchmark is broadcast as a hash set if its texts come to ``max_broadcast_bytes``
    at most, and no exchange takes place; otherwise :func:`decontaminate_by_join` runs.
    """
    judge = _judge(docs, benchmark, window, with_text, max_broadcast_bytes)
    if judge is None:
        return decontaminate_by_join(docs, benchmark, window, id_column, text_column, with_text)
    fields = _FIELDS if with_text else {k: v for k, v in _FIELDS.items() if k != "cleaned_text"}
    return per_text(docs, id_column, text_column, judge, fields, keep_null=True)


def annotate(docs: DataFrame, benchmark: DataFrame, column: str, window: int = WINDOW,
             text_column: str = "text",
             max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with a boolean column: whether the text is contaminated."""
    judge = _judge(docs, benchmark, window, False, max_broadcast_bytes)
    if judge is not None:
        fields = {k: v for k, v in _FIELDS.items() if k != "cleaned_text"}
        return (with_answer(docs, column, text_column, judge, fields)
                .withColumn(column, F.col(column).getField("contaminated")))
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(text_column, F.lit("")), 256))
    texts = keyed.groupBy("__key").agg(F.first(text_column).alias("__body"))
    told = decontaminate_by_join(texts, benchmark, window, "__key", "__body")
    return (keyed.join(told.select("__key", F.col("contaminated").alias(column)), "__key")
            .drop("__key"))


def without(data: bytes, hit) -> bytes:
    """The text without its hit words; what stands before a hit word stays."""
    kept, at = [], 0
    for found, bad in zip(_WORD.finditer(data.translate(WORD_BYTES)), hit):
        if bad:
            kept.append(data[at:found.start()])
            at = found.end()
    return b"".join([*kept, data[at:]])


def _cleaned(texts: pd.Series, places: pd.Series) -> pd.Series:
    """Texts without the words at the given places, null ones null."""
    def of(data, at):
        if data is None:
            return None
        if at is not None and len(at):
            bad = set(map(int, at))
            data = without(data, (i in bad for i in itertools.count()))
        return data.decode("utf-8", "replace")

    return pd.Series([of(d, a) for d, a in zip(texts, places)], dtype=object)


def _judge(docs: DataFrame, benchmark: DataFrame, window: int, with_text: bool,
           max_broadcast_bytes: int):
    """What prepares a task for judging texts; None if the benchmark is too large to broadcast."""
    named = benchmark.where("item_id is not null and octet_length(text) > 0").select(
        "item_id", F.col("text").cast("binary").alias("text"))
    # every row that is sent counts with its id, so the bound holds for the rows too
    size = named.agg(F.sum(F.octet_length("text") + F.octet_length(
        F.col("item_id").cast("string")))).first()[0] or 0
    if size > max_broadcast_bytes:
        return None
    items = named.collect()
    windows = item_windows(((r[0], bytes(r[1]) if r[1] is not None else None) for r in items),
                           window)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def prepare():
        known = WindowSet(shared.value)

        def judge(data):
            words = words_of(data)
            hit, found = known.hits(words)
            n_hit = int(hit.sum())
            out = (len(words), n_hit, len(found), _digest(found),
                   n_hit > 0 and 20 * n_hit >= len(words))
            if not with_text:
                return out
            if n_hit and data is not None:
                data = without(data, hit.tolist())
            return (*out, data.decode("utf-8", "replace") if data is not None else None)

        return judge

    return prepare


def _word_list(column):
    lowered = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")),
                                F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def _window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    numbers = np.fromiter((of(w) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    return WindowSet.rolled(np.stack([numbers[k:k + n] for k in range(size)]))


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    bits = np.uint64(FILTER_BITS)
    return (hashes % bits).astype(np.int64), (hashes // bits * np.uint64(_MIX) % bits).astype(np.int64)


def _window_filter(benchmark: DataFrame, window: int) -> tuple[list[int], np.ndarray]:
    """The sizes of the benchmark's windows and a Bloom filter of them, made on the executors.

    The filter's size is fixed; a larger benchmark lets more windows pass, which the join
    then drops.
    """
    def make(batches):
        bits, sizes = np.zeros(FILTER_BITS >> 3, np.uint8), set()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words = words_of(data)
                size = min(window, len(words))
                if size:
                    sizes.add(size)
                    for at in _places(_window_hashes(words, size)):
                        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        chunks = [(i, c) for i, c in enumerate(bits.reshape(_FILTER_CHUNKS, -1)) if c.any()]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([i for i, _ in chunks] + [-1 - x for x in sizes], pa.int32()),
            "bits": pa.array([zlib.compress(c.tobytes(), 1) for _, c in chunks] + [b""] * len(sizes),
                             pa.binary())})

    def add(batches):
        total = {}
        for batch in batches:
            for i, blob in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(blob), np.uint8) if i >= 0 else None
                total[i] = part if i not in total or i < 0 else total[i] | part
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(list(total), pa.int32()),
            "bits": pa.array([zlib.compress(c.tobytes(), 1) if c is not None else b""
                              for c in total.values()], pa.binary())})

    shape = "chunk int, bits binary"
    small_batches(benchmark.sparkSession)
    items = benchmark.where("item_id is not null").select(F.coalesce("text", F.lit("")).cast("binary"))
    out, sizes = np.zeros((_FILTER_CHUNKS, FILTER_BITS // 8 // _FILTER_CHUNKS), np.uint8), []
    for i, blob in items.mapInArrow(make, shape).repartition("chunk").mapInArrow(add, shape).collect():
        if i < 0:
            sizes.append(-1 - i)
        else:
            out[i] = np.frombuffer(zlib.decompress(bytes(blob)), np.uint8)
    return sorted(sizes), out.reshape(-1)


def decontaminate_by_join(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                          id_column: str = "doc_id", text_column: str = "text",
                          with_text: bool = False) -> DataFrame:
    """The same rows for a benchmark of any size: windows of both sides meet in a join.

    Of the documents only windows that pass a Bloom filter of the benchmark's (16 MB,
    broadcast) are exchanged, with their words, which decide; texts stay where they are but
    for ``with_text``. Rows of ``docs`` with the same text are answered together.
    """
    small_batches(docs.sparkSession)
    sizes, bits = _window_filter(benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    body = [F.col(text_column).cast("binary").alias("__body")] if with_text else []
    text = F.coalesce(text_column, F.lit(""))
    texts = docs.select(F.col(id_column).alias("__id"), F.size(_word_list(F.col(text_column))).alias("__n"),
                        F.sha2(text, 256).alias("__t"), *body)

    def passing(batches):
        """Windows of texts that pass the filter: text, size, place, words."""
        known = shared.value
        for batch in (x for whole in batches for x in pieces_of(whole, 1)):
            out = [[], [], [], []]
            for t, data in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(data)
                for size in sizes:
                    hashes = _window_hashes(words, size)
                    hit = np.ones(len(hashes), bool)
                    for at in _places(hashes):
                        hit &= (known[at >> 3] >> (at & 7) & 1) > 0
                    for i in np.flatnonzero(hit).tolist():
                        for column, value in zip(out, (t, size, i, b" ".join(words[i:i + size]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()),
                pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                names=["__t", "size", "at", "key"])

    def windows(words, size):
        last = F.size(words) - size
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.array_join(F.slice(words, i + 1, size), " ").cast("binary")))

    items = (benchmark.where("item_id is not null")
             .select(F.col("item_id").cast("string").alias("item"), _word_list(F.col("text")).alias("w"))
             .where(F.size("w") > 0)
             .withColumn("size", F.least(F.size("w"), F.lit(window))))
    keys = items.select("item", "size", F.explode(
        windows(F.col("w"), F.col("size"))).alias("key")).distinct()
    grouped = keys.groupBy("size", "key").agg(F.collect_set("item").alias("items"))
    met = (docs.select(F.sha2(text, 256).alias("__t"), text.cast("binary").alias("__text"))
           .mapInArrow(passing, "__t string, size int, at int, key binary").distinct()
           .join(grouped, ["size", "key"]))
    found = met.groupBy("__t").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("size") - 1))))
        .alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    n_hit = F.coalesce(F.size("hit"), F.lit(0))
    n_hit = F.when(F.col("hit").isNull(), 0).otherwise(n_hit)
    n_words = F.col("__n")
    none = F.coalesce("items", F.array().cast("array<string>"))
    cleaned = []
    if with_text:
        cleaned = [F.pandas_udf(_cleaned, "string")("__body", "hit").alias("cleaned_text")]
    return (texts.join(found, "__t", "left").select(
        F.col("__id").alias(id_column), n_words.cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"), F.size(none).cast("long").alias("n_items"),
        F.sha2(F.array_join(none, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"), *cleaned))
