"""How many tasks the near_dedup stage takes, and the components that it rests on."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_similar import planted

from driftline.llm import components as joined
from driftline.llm import similar, stages


def roots_of(edges):
    """The least node that links lead to, for every node."""
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graphs():
    rng = random.Random(4)
    chain = rng.sample(range(-10**9, 10**9), 300)
    return {"chain": list(zip(chain, chain[1:])),
            "star of a high node": [(9999, i) for i in range(600)],
            "random": [(rng.randrange(2000), rng.randrange(2000)) for _ in range(900)],
            "loops": [(1, 1), (2, 3), (3, 2), (2, 3)], "none": []}


@pytest.mark.parametrize("name", list(graphs()))
def test_components(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = roots_of([e for e in edges if e[0] != e[1]])
    found = joined.components(df, roots=True).collect()
    assert len(found) == len(want) and {r.node: r.root for r in found} == want
    found = joined.components(df).collect()
    assert {r.node: r.root for r in found} == {k: v for k, v in want.items() if k != v}


def test_contracted_edges_join_the_same_nodes():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    nodes, roots = joined.contracted(a, b)
    assert dict(zip(nodes.tolist(), roots.tolist())) == roots_of(list(zip(a.tolist(), b.tolist())))


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_a_task_contracts_its_edges_in_chunks(monkeypatch, chunk):
    monkeypatch.setattr(joined, "CHUNK", chunk)
    rng = np.random.default_rng(7)
    edges = rng.integers(0, 60, (50, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
               for x in np.split(edges, 10)]
    got = [r for x in joined._contract(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns[:2]))]
    assert roots_of(got) == roots_of(edges.tolist())
    assert {a for a, _ in got} == set(edges.ravel().tolist()) and all(b <= a for a, b in got)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_a_small_star_may_go_on_for_batches(size):
    rows = [(3, 3, False), (5, 3, False), (5, 3, True), (7, 2, False), (7, 3, False), (7, 3, False), (9, 9, False)]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array(x) for x in zip(*rows[i:i + size])], names=["a", "b", "moved"])
        for i in range(0, len(rows), size)]
    got = {r for x in joined._small_star(iter(batches)) for r in zip(*(c.to_pylist() for c in x.columns))}
    assert {(a, b) for a, b, _ in got} == {(3, 3), (5, 3), (7, 2), (3, 2), (9, 9)}
    assert {a for a, _, moved in got if moved} == {5, 3} and (9, 9, False) in got


def test_a_neighbour_of_many_moves_once():
    a = np.repeat(np.arange(10, 510), 2)
    b = np.tile([1, 5], 500)
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(1000, bool))],
                                       names=["a", "b", "moved"])
    (got,) = joined._small_star(iter([batch]))
    rows = list(zip(*(c.to_pylist() for c in got.columns)))
    assert rows.count((5, 1, True)) == 1 and len(rows) == 501


def tasks_of(spark, run):
    """How many tasks ``run`` takes where every exchange has as many partitions as it was given."""
    conf, context = "spark.sql.adaptive.coalescePartitions.enabled", spark.sparkContext
    before, group = spark.conf.get(conf), f"counted-{random.random()}"
    spark.conf.set(conf, "false")
    context.setJobGroup(group, "")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(conf, before)
    tracker = context.statusTracker()
    stages_of = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages_of) if x)


def test_tasks_of_a_table_with_a_large_group(spark, monkeypatch):
    """Every task leaves files and events: some tables have more partitions than rows worth it."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    assert tasks_of(spark, lambda: stages.near_dedup(spark, docs, "").count()) < 1700
