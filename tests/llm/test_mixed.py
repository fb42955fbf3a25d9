"""Rows that share id and text under several sources."""

import duckdb
from pyspark.sql import functions as F

from driftline.llm import mixing, queries


def test_copies_keep_their_source(spark):
    rows = [(1, "one two three four", "a", "en"), (1, "one two three four", "b", "de"),
            (1, "one two three four", None, "fr"), (1, "one two three four", None, "es"),
            (2, "five six", "a", "en"), (3, "seven eight nine", "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mix = mixing.Mix(docs)
    want = {r.source: r.taken for r in mix.taken().groupBy("source").agg(
        F.sum("taken").alias("taken")).collect() if r.taken}
    seen = []
    for shuffled in (docs, docs.orderBy(F.desc("lang"))):
        got = {}
        rows = mixing.mix_documents(shuffled).collect()
        for r in rows:
            got[r.source] = got.get(r.source, 0) + len(r.text.split())
        assert got == want
        seen.append(sorted((r.doc_id, r.text, r.source or "", r.lang) for r in rows))
    assert seen[0] == seen[1]


def test_crowds_of_rows_without_ids_and_of_repeats(spark, monkeypatch):
    """Neither meets in one bucket, and all rows come back as the SQL has them."""
    rows = [(None, f"text {i % 500} " + "w " * (i % 7), "a" if i % 3 else None) for i in range(2000)]
    rows += [(7, "the same row again", "b")] * 3000 + [(8, "", "b")] * 5 + [(i, f"t {i}", "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    got = sorted((tuple(r) for r in mixing.mix_report(docs).select(
        "doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(f"select doc_id, size, source_size, target, taken from "
                       f"({queries.ORACLES['op2_mix_sources']})").fetchall()
    assert got == sorted(want, key=repr)
