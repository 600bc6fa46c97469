"""Connected components of a graph given as pairs, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut

PAIRS = "a long, b long"
#: So few pairs (32 MB) are finished in one task; more go on in rounds over all executors, with the same result.
ONE_TASK = 2_000_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the least node of each one's component."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        x, y = x[apart], y[apart]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a partition as stars: each node with the least node it is joined to there; lone ones with themselves."""
    a = b = np.zeros(0, np.int64)
    alone: list[np.ndarray] = []
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if (x == y).any():
            alone = [np.unique(np.concatenate([*alone, x[x == y]]))]
        a, b = np.r_[a, x[x != y]], np.r_[b, y[x != y]]
        if len(a) > 200_000:
            node, root = smallest(a, b)
            a, b = node[node != root], root[node != root]
    node, root = smallest(a, b)
    far = node != root
    loops = np.setdiff1d(np.concatenate(alone), node[far]) if alone else node[:0]
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[far], loops]), pa.array(np.r_[root[far], loops])], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    node, root = smallest(*(np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["root", "top"])


def components(pairs: DataFrame) -> DataFrame:
    """node, root: every node of the pairs (a, b) with the least node of its component.

    Partitions contract their pairs to stars first. Then, until at most ONE_TASK pairs are left, each node hooks onto its
    least neighbour, pointers jump once, and pairs are renamed by their roots; each round at least halves the
    nodes of a component. Rounds are cut by tables in the shared folder. Pairs with a null end are no pairs; a
    node paired with itself is its own component; repeated pairs count once.
    """
    pairs = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    stars = cut(pairs.mapInArrow(contract, PAIRS), "pairs")
    loops = stars.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    edges = stars.where("a <> b")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while (left := edges.count()) > ONE_TASK:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hooks")
        jump = hook.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        hook = cut(hook.join(jump, "up").select("a", F.col("upper").alias("up")), "jumps")
        roots = roots.join(hook.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = cut(roots, "roots")
        renamed = edges.join(hook, "a").select("b", F.col("up").alias("x")).join(hook.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = cut(renamed.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).mapInArrow(contract, PAIRS), "pairs")
    if left:
        last = edges.coalesce(1).mapInArrow(_finish, "root long, top long")
        roots = roots.join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return roots.unionByName(loops.join(roots.select("node"), "node", "left_anti"))
