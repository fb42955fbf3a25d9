"""What the near_dedup stage leaves on disk: pairs and groups by chance, texts, exchanged files."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similar import kept_of, planted

from driftline.llm import common, similar, stages


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def seen_of(spark, monkeypatch, rows):
    """Members of the groups that are compared first, with the shingles in no order of rarity."""
    seen, blocks = [], similar._blocks
    monkeypatch.setattr(similar, "bucket_counts", lambda *a, **b: np.zeros(similar.BUCKETS, np.int64))
    monkeypatch.setattr(similar, "_blocks", lambda members: seen.append(members) or blocks(members))
    kept = stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == kept_of(rows)
    return seen[0]


def test_texts_that_share_a_line_by_chance_make_no_pairs(spark, monkeypatch):
    rng = random.Random(1)
    texts = [words(rng, 80) for _ in range(200)]
    for _ in range(40):
        line = words(rng, 5)
        for i in rng.sample(range(200), 10):
            texts[i] += line
    members = seen_of(spark, monkeypatch, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert members.count() < 10


def test_lines_of_many_do_not_chain_all_texts(spark, monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, 14) for _ in range(400)]
    for k in range(10):  # every line shares some texts with the next
        line = words(rng, 8)
        for i in range(40 * k, min(400, 40 * k + 60)):
            texts[i] += line
    members = seen_of(spark, monkeypatch, [(i, " ".join(t)) for i, t in enumerate(texts)])
    largest = members.groupBy("group").count().agg(F.max("count")).first()[0]
    assert 12 < largest <= 120


def test_one_exchange_carries_texts(spark):
    kept = stages.near_dedup(spark, spark.createDataFrame(planted(), "doc_id long, text string"), "")
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    inputs = [part.split("Input", 1)[1].split("\n")[0] for part in plan.split("\n\n")
              if ") Exchange" in part.split("\n")[0] and "Input" in part]
    assert sum("text#" in x or "valueWithExtremumOrdering" in x for x in inputs) == 1


def test_rows_alike_in_id_and_text_stay_once(spark):
    text = " ".join(words(random.Random(3), 30))
    rows = [(None, text, "b"), (None, text, "a"), (None, text, None), (7, text, "c"), (7, text, "a"),
            (None, None, "x"), (None, "", "w"), (5, " ", "y")]
    kept = stages.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert {tuple(r) for r in kept.collect()} == {(7, text, "a"), (5, " ", "y")} and kept.count() == 2


def test_bits_of_wanted_keys_grow_with_the_keys(spark):
    bits = similar.key_bits(spark.range(0, 600_000, 6).withColumnRenamed("id", "key"))
    some = np.unpackbits(bits, bitorder="little")
    assert some[np.arange(0, 600_000, 6) % len(some)].all() and some.mean() <= 1 / 16


@pytest.mark.parametrize("n, power", [(0, 4), (4, 4), (5, 8), (8, 8), (9, 16), (1 << 40, 64)])
def test_power_for(n, power):
    assert similar.power_for(n, 4, 64) == power


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_cut_leaves_no_exchanged_files(spark):
    before = shuffled(spark)
    rows = common.cut(spark.range(1000).repartition(3, "id").withColumn("x", F.col("id") + 1))
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert rows.agg(F.sum("x")).first()[0] == 500_500 and rows.count() == 1000
