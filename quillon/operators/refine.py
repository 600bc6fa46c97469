"""Refining a clustering over several density levels; a tree of nodes is kept beside the labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.dbscan import dbscan
from quillon.operators.neighbors import k_nearest
from quillon.runtime import cut

Score = Callable[[DataFrame], dict[int, tuple[float, int]]]
Merge = Callable[[DataFrame], dict[int, int]]


@dataclass
class Node:
    """A cluster of one level: score, occurrences, rows, time, parents and whether it is done."""

    id: int
    level: int
    score: float = 0.0
    occurrences: int = 0
    rows: int = 0
    time: int = 0
    parents: list[int] = field(default_factory=list)
    done: bool = False


def eps_ladder(least: float, most: float, steps: int, rising: bool = True) -> list[float]:
    """Equally spaced eps values, both ends included."""
    values = [least + (most - least) * i / (steps - 1) for i in range(steps)] if steps > 1 else [most]
    return values if rising else values[::-1]


def _summary(labels: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and time per cluster: one row per cluster."""
    return {r[0]: (r[1], r[2] or 0) for r in labels.where("cluster_id > 0").groupBy("cluster_id").agg(F.count(F.lit(1)), F.sum("duration")).collect()}


def refine_aggregative(points: DataFrame, dims: Sequence[str], ladder: Sequence[float], min_points: int, score: Score, merge: Merge | None = None) -> tuple[DataFrame, list[Node]]:
    """Density clustering at rising eps; clusters with a score below 1, and noise, are clustered again at the next.

    A new cluster takes the id of its lowest parent not yet taken, else a new one. Stops when nothing is left
    to cluster. ``points`` has id, dims and duration; ``score`` gives (score, occurrences) per cluster of
    (id, cluster_id). ``merge`` gives for the final labels the clusters that occupy the same columns (C24), each
    with the id it takes; the tree keeps them as they were found.
    """
    nodes: list[Node] = []
    labels = cut(points.select("id", F.lit(0).alias("cluster_id")), "labels")
    done: set[int] = set()
    for level, eps in enumerate(ladder):
        left = points.join(labels.where(~F.col("cluster_id").isin(*done)) if done else labels, "id")
        if left.isEmpty():
            break
        fresh = cut(dbscan(left.select("id", *dims), dims, eps, min_points).withColumnRenamed("cluster_id", "_new"), "fresh")
        both = labels.join(fresh, "id")
        shared = both.where("_new > 0").groupBy("_new").agg(F.array_sort(F.collect_set("cluster_id")).alias("parents")).orderBy("_new").collect()
        taken, names, top = set(done), {}, max([n.id for n in nodes], default=0)
        for r in shared:
            old = next((p for p in r["parents"] if p > 0 and p not in taken), None)
            if old is None:
                top += 1
                old = top
            taken.add(old)
            names[r["_new"]] = (old, [p for p in r["parents"] if p > 0])
        mapped = F.coalesce(*[F.when(F.col("_new") == k, v[0]) for k, v in names.items()], F.lit(0)) if names else F.lit(0)
        labels = cut(labels.join(fresh, "id", "left").select("id", F.when(F.col("_new").isNull(), F.col("cluster_id")).otherwise(mapped).alias("cluster_id")), "labels")
        scores, sizes = score(labels), _summary(labels.join(points.select("id", "duration"), "id"))
        for new, parents in sorted(names.values()):
            value, occurrences = scores.get(new, (0.0, 0))
            rows, time = sizes.get(new, (0, 0))
            nodes.append(Node(new, level, value, occurrences, rows, time, parents, value >= 1))
            if value >= 1:
                done.add(new)
    names = {k: v for k, v in merge(labels).items() if k != v} if merge else {}
    if names:
        labels = cut(labels.select("id", F.coalesce(*[F.when(F.col("cluster_id") == k, v) for k, v in names.items()], "cluster_id").alias("cluster_id")), "labels")
    return labels, nodes


def worth_splitting(node: Node, time: int, occurrences: int) -> bool:
    """The candidates for a split; shares are whole-number divisions, so only a node that has all can pass by share."""
    return (node.occurrences > 1 and node.score > 0.85) or (node.time // max(time, 1) > 0.25 and node.score > 0.6) or (node.occurrences // max(occurrences, 1) > 0.25 and node.score > 0.6)


def refine_divisive(points: DataFrame, dims: Sequence[str], ladder: Sequence[float], min_points: int, score: Score, candidate: Callable[[Node, int, int], bool] = worth_splitting) -> tuple[DataFrame, list[Node]]:
    """Density clustering at falling eps inside candidate nodes; a split is kept unless it is all noise, loses 60 % of the time to noise, or scores below 80 % of its parent.

    At the end the noise of each split goes to the nearest of its clusters (C27), and single children are taken out of the tree (C26).
    """
    labels = cut(dbscan(points.select("id", *dims), dims, ladder[0], min_points), "labels")
    timed = points.select("id", "duration")
    scores, sizes = score(labels), _summary(labels.join(timed, "id"))
    nodes = [Node(c, 0, *scores.get(c, (0.0, 0)), *sizes[c]) for c in sorted(sizes)]
    live = list(nodes)
    splits: list[DataFrame] = []
    for level, eps in enumerate(ladder[1:], 1):
        time, occurrences = sum(n.time for n in live), sum(n.occurrences for n in live)
        grown: list[Node] = []
        for node in live:
            if not candidate(node, time, occurrences):
                continue
            own = points.join(labels.where(F.col("cluster_id") == node.id).select("id"), "id", "left_semi")
            parts = cut(dbscan(own.select("id", *dims), dims, eps, min_points).withColumnRenamed("cluster_id", "_part"), "parts")
            part_sizes = _summary(parts.withColumnRenamed("_part", "cluster_id").join(timed, "id"))
            kept = sum(t for _, t in part_sizes.values())
            if len(part_sizes) < 2 or node.time - kept >= 0.6 * node.time:
                continue
            base = max(n.id for n in [*nodes, *grown])
            trial = labels.join(parts, "id", "left").select("id", F.when(F.col("_part").isNull(), F.col("cluster_id")).when(F.col("_part") == 0, 0).otherwise(F.col("_part") + base).alias("cluster_id"))
            trial = cut(trial, "trial")
            fresh = score(trial)
            weighted = sum(fresh.get(base + k, (0.0, 0))[0] * t for k, (_, t) in part_sizes.items()) / max(kept, 1)
            if weighted < 0.8 * node.score:
                continue
            labels = trial
            splits.append(parts)
            grown += [Node(base + k, level, *fresh.get(base + k, (0.0, 0)), r, t, [node.id]) for k, (r, t) in sorted(part_sizes.items())]
        if not grown:
            break
        nodes += grown
        live = grown
    adopted = [_adopted(points, labels, parts, dims) for parts in splits]
    if adopted:
        found = adopted[0]
        for more in adopted[1:]:
            found = found.unionByName(more)
        labels = cut(labels.join(found, "id", "left").select("id", F.coalesce("_new", "cluster_id").alias("cluster_id")), "labels")
    return labels, collapse(nodes)


def _adopted(points: DataFrame, labels: DataFrame, parts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(id, _new): points that a split made noise with the cluster of their nearest neighbour among those it kept."""
    kept = labels.where("cluster_id > 0").join(parts.where("_part > 0").select("id"), "id", "left_semi")
    noise = points.join(parts.where("_part = 0").select("id"), "id", "left_semi")
    nearest = k_nearest(noise, points.join(kept.select("id"), "id", "left_semi"), dims, 1).select("id", "other")
    return nearest.join(kept.select(F.col("id").alias("other"), F.col("cluster_id").alias("_new")), "other").select("id", "_new")


def collapse(nodes: list[Node]) -> list[Node]:
    """Nodes that are the only child of their parent are left out, their children pass to the parent."""
    children: dict[int, list[Node]] = {}
    for n in nodes:
        for p in n.parents:
            children.setdefault(p, []).append(n)
    single = {c[0].id: p for p, c in children.items() if len(c) == 1 and c[0].parents == [p] and c[0].id != p}

    def top(i: int) -> int:
        while i in single:
            i = single[i]
        return i

    return [Node(n.id, n.level, n.score, n.occurrences, n.rows, n.time, [top(p) for p in n.parents], n.done) for n in nodes if n.id not in single]


def reclassify_noise(points: DataFrame, labels: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Noise takes the cluster of its nearest clustered point, ties by id; points with a null coordinate stay noise."""
    noise = points.join(labels.where("cluster_id = 0").select("id"), "id", "left_semi")
    known = points.join(labels.where("cluster_id > 0").select("id"), "id", "left_semi")
    nearest = k_nearest(noise, known, dims, 1).select("id", "other")
    found = nearest.join(labels.select(F.col("id").alias("other"), F.col("cluster_id").alias("_new")), "other").select("id", "_new")
    return labels.join(found, "id", "left").select("id", F.coalesce("_new", "cluster_id").alias("cluster_id"))
