"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut

#: Edges that a task contracts at once; any number gives the same result.
CHUNK = 1 << 20
#: Nodes with the most neighbours above them whose least neighbours a large-star step broadcasts.
HEAVY_NODES = 1_000


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of some edges and the least node that these edges lead to, itself included."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches):
    """Edges (a, b) as (node, least node of its chunk); a chunk's nodes stay joined."""
    held, size = [], 0

    def close():
        a, b = contracted(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(np.ones(len(a), bool))], names=["a", "b", "moved"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= CHUNK:
            yield close()
            held, size = [], 0
    if size:
        yield close()


def _small_star(batches):
    """A node and its neighbours below move to the least of them; rows sorted by (a, b).

    A node's rows may go on from batch to batch; only its least neighbour is held.
    """
    last = least = None
    for batch in batches:
        a, b, moved = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(a):
            continue
        new = np.append(last is None or a[0] != last, a[1:] != a[:-1])
        first = np.where(new, b, 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        root = np.where(start >= 0, first[start], 0 if least is None else least)
        other = b != root
        last, least = a[-1], root[-1]
        # the node's own row, a mark that something moved, and the neighbours' rows, each once:
        # many nodes may have the same neighbour
        more = ~new & (other | moved)
        pairs = np.unique(np.stack([np.where(other, b, a)[more], root[more]]), axis=1)
        out_a, out_b = np.concatenate([a[new], pairs[0]]), np.concatenate([root[new], pairs[1]])
        flags = np.concatenate([moved[new], np.ones(len(out_a) - int(new.sum()), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b), pa.array(flags)],
                                         names=["a", "b", "moved"])


def evened(df: DataFrame) -> DataFrame:
    """A union in as many partitions as an exchange has, without an exchange."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every edge moves to the least neighbour of its lower node.

    The nodes with the most neighbours above them meet their edges by broadcast, and these
    edges are spread by their upper nodes, so that they don't meet in one task.
    """
    node = F.explode(F.array(
        F.struct(F.col("a").alias("of"), F.col("b").alias("least"), F.lit(0).alias("above")),
        F.struct(F.col("b").alias("of"), F.col("b").alias("least"), F.lit(1).alias("above")))).alias("node")
    nodes = edges.select(node).groupBy("node.of").agg(
        F.min("node.least").alias("least"), F.sum("node.above").alias("above"))
    heavy = nodes.orderBy(F.col("above").desc(), "of").limit(HEAVY_NODES).select(
        F.col("of").alias("__heavy"), F.col("least").alias("__heavy_least"))
    met = edges.join(F.broadcast(heavy), F.col("b") == F.col("__heavy"), "left").withColumn(
        "__own", F.when(F.col("__heavy").isNull(), F.col("b")).otherwise(F.xxhash64("a")))
    least = F.coalesce("__heavy_least", "least")
    return met.join(nodes.select("of", "least"), F.col("__own") == F.col("of"), "left").select(
        "a", least.alias("b"), (F.col("b") != least).alias("moved"))


def components(edges: DataFrame, roots: bool = False) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (a, b).

    The roots themselves have a row only with ``roots``. Every task first contracts the
    edges it reads, a bounded number at a time, so that what reaches the exchanges are
    stars. Then the two steps are the published star contraction: the number of rounds
    grows with the logarithm of the longest chain. A small-star step streams a node's lower
    neighbours, of which a contracted chunk gives one. Each round is cut to the checkpoint folder, and the last is the one
    that moves nothing.
    """
    shape = "a long, b long, moved boolean"
    edges = cut(edges.where("a <> b").select("a", "b").mapInArrow(_contract, shape))
    while True:
        edges = cut(_large_star(edges).repartition("a").sortWithinPartitions("a", "b")
                    .mapInArrow(_small_star, shape))
        if edges.where("moved").isEmpty():
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found if roots else found.where("node <> root")
