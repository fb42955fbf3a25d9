"""How the wording of sources diverges within a language, from Arrow partial counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut, pieces_of, small_batches, whole_text

#: What stands between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term occurs in, at least; ranks of the term part.
LEAST_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Partial counts a task holds before it hands them on; (term, source) counts of one shard.
HELD, SHARD_CELLS = 200_000, 500_000

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                      ("n", pa.int64()), ("d", pa.int64())])


def _merged(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts)
    out = whole.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("d", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "d_sum"]).rename_columns(_COUNTED.names)


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a batch (lang, source, text).

    Every (lang, source) also has a row with the empty term, which no text holds.
    """
    lang, source, text = batch.columns
    split = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row = pc.list_parent_indices(split)
    term = pc.list_flatten(split).dictionary_encode()
    met = pa.table({"row": pc.cast(row, pa.int64()), "code": term.indices})
    met = met.group_by(["row", "code"]).aggregate([([], "count_all")])
    names = term.dictionary.take(met["code"].combine_chunks())
    table = pa.table({"lang": lang.take(met["row"]), "source": source.take(met["row"]),
                      "term": names, "n": met["count_all"],
                      "d": pa.array(np.ones(len(met), np.int64))})
    table = table.filter(pc.not_equal(table["term"], ""))
    none = np.zeros(len(batch), np.int64)
    groups = pa.table({"lang": lang, "source": source, "term": pa.array([""] * len(batch)),
                       "n": none, "d": none})
    return _merged([table.cast(_COUNTED), groups.cast(_COUNTED)])


def term_counts(docs: DataFrame, lang_column: str = "lang", source_column: str = "source",
                text_column: str = "text") -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term and documents that hold it.

    Terms are runs of ASCII letters and code points above ASCII, only A-Z lower-cased. A
    null text, lang or source counts as empty. A group without terms has its one row with
    the empty term, n and d 0. Tasks hand on partial counts, so a hot group or a frequent
    term meets as one row for each task.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_column, "lang"), (source_column, "source"))], whole_text(text_column).alias("text"))

    def run(batches):
        held, size = [], 0
        for batch in (x for whole in batches for x in pieces_of(whole, 2)):
            held.append(count_terms(batch))
            size += len(held[-1])
            if size > HELD:
                held = [_merged(held)]
                if (size := len(held[0])) > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from _merged(held).to_batches()

    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, d long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact by long division to the base 1000."""
    share, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        share = share * 1000 + rest // total
        rest = rest % total
    return share + 1


def terms_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    return (p - q) * (p - q) // (p + q)


def _shard(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Partial sums of all pairs of one language, and the foremost terms, over a shard's terms.

    ``counts`` holds term, source, n; ``groups`` the language's sources (group) with their
    totals and the language's total and number of terms. A block of terms at a time becomes a matrix.
    """
    source = groups["group"].to_pylist()
    place = {s: i for i, s in enumerate(source)}
    width = len(source)
    kept = groups["v"][0].as_py()
    totals = groups["total"].to_numpy() + 2 * kept
    whole = groups["lang_total"][0].as_py() + 2 * kept
    sums = np.zeros((width, width), np.int64)
    best: list[list[tuple]] = [[] for _ in source]
    term = pa.concat_arrays([pa.array([], pa.string()), *counts["term"].chunks]).dictionary_encode()
    names = term.dictionary.to_pylist()
    at = np.fromiter((place[s] for s in counts["source"].to_pylist()), np.int64, len(counts))
    codes, n = term.indices.to_numpy(), counts["n"].to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, at, n = codes[order], at[order], n[order]
    block = max(1, SHARD_CELLS // max(width, 1))
    for lo in range(0, len(names), block):
        hi = min(lo + block, len(names))
        a, b = np.searchsorted(codes, [lo, hi])
        matrix = np.zeros((hi - lo, width), np.int64)
        matrix[codes[a:b] - lo, at[a:b]] = n[a:b]
        p = shares(matrix + 2, totals[None, :])
        for i in range(width - 1):
            sums[i, i + 1:] += terms_of(p[:, i:i + 1], p[:, i + 1:]).sum(axis=0)
        q = shares(matrix.sum(axis=1) + 2, whole)
        value = terms_of(p, q[:, None])
        wanted = (matrix > 0) & (p > q[:, None])
        for i in range(width):
            rows = np.flatnonzero(wanted[:, i])
            if len(rows) > TOP:
                rows = rows[value[rows, i] >= np.partition(value[rows, i], -TOP)[-TOP]]
            found = [(-int(value[r, i]), names[lo + r].encode(), names[lo + r]) for r in rows]
            best[i] = sorted(best[i] + found)[:TOP]
    sums += sums.T
    lang, out = key[0].as_py(), {"source": [], "part": [], "item": [], "value": []}
    for i, s in enumerate(source):
        pairs = [(o, int(sums[i, j])) for j, o in enumerate(source) if j != i]
        terms = [(t, -v) for v, _, t in best[i]]
        for part, items in (("pair", pairs), ("term", terms)):
            out["source"] += [s] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += [x for x, _ in items]
            out["value"] += [x for _, x in items]
    return pa.table({"lang": pa.array([lang] * len(out["item"]), pa.string()), **{
        k: pa.array(v, pa.int64() if k == "value" else pa.string()) for k, v in out.items()}})


def audit_sources(docs: DataFrame, lang_column: str = "lang", source_column: str = "source",
                  text_column: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources and their foremost terms.

    A language keeps its V terms in ``least`` of its documents or more; a group's share of a
    term is p = 1 + floor(1e9 (count + 2) / (N + 2 V)), N its occurrences of kept terms.
    Part ``pair``: each other source of the language, value the sum over kept terms of
    floor((p - q)^2 / (p + q)). Part ``term``: the ten foremost terms that a source uses
    more than its language. Equal values rank by item. A language with one source has no
    pair, one without kept terms has pairs of value 0. An empty table gives an empty report.

    Partial counts are merged once; the merged table is cut and dealt to shards of some
    ``SHARD_CELLS`` counts by term, each a columnar group with its language's totals. What a
    shard returns grows with the pairs of sources, as the report does, not with the terms.
    """
    counted = cut(term_counts(docs, lang_column, source_column, text_column))
    of_term = F.sum("d").over(Window.partitionBy("lang", "term"))
    cells = cut(counted.where("term <> ''").withColumn("__d", of_term)
                .where(F.col("__d") >= least).select("lang", "term", "source", "n"))
    # every group has its row with the empty term
    totals = (cells.select("lang", "source", "n")
              .unionByName(counted.where("term = ''").select("lang", "source", "n"))
              .groupBy("lang", "source").agg(F.sum("n").alias("total")))
    of_lang = (cells.groupBy("lang", "term").agg(F.sum("n").alias("n"))
               .groupBy(F.col("lang").alias("__lang"))
               .agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v")))
    groups = totals.join(of_lang, F.col("lang") == F.col("__lang"), "left").select(
        "lang", "source", "total", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lang_total", "v")])
    shards = 1 + cells.count() // SHARD_CELLS
    shard = F.pmod(F.xxhash64("term"), F.lit(shards))
    dealt = groups.select(
        F.col("lang").alias("of"), F.col("source").alias("group"), "total", "lang_total", "v",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("nr"))
    found = cells.withColumn("shard", shard).groupBy("lang", "shard").cogroup(
        dealt.groupBy("of", "nr")).applyInArrow(
            _shard, "lang string, source string, part string, item string, value long")
    whole = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return whole.withColumn("rank", F.row_number().over(ranked)).where(
        (F.col("part") == "pair") | (F.col("rank") <= TOP))
