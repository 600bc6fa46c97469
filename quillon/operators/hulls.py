"""Convex hulls of clusters in two dimensions, their merge, and classification by hull."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.dbscan import dbscan
from quillon.operators.neighbors import radius_pairs
from quillon.runtime import cut, one_row

CORNER = "struct<x:double,y:double,instance:long,near:long>"
HULL = f"cluster_id long, density long, total_time long, points array<{CORNER}>"
GRID = 50
SHIPPED_CORNERS = 200_000  #: about 5 MB
DIRECTIONS = 16  #: outermost points in so many directions tell most inner points


def _outside(points: np.ndarray) -> np.ndarray:
    """Row numbers of the points that don't lie inside the polygon of the outermost ones."""
    angle = np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS
    far = (points @ np.stack([np.cos(angle), np.sin(angle)])).argmax(0)
    ring = points[far[np.r_[True, far[1:] != far[:-1]]]]
    inside = np.ones(len(points), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0)):
        if (ax, ay) != (bx, by):
            inside &= (bx - ax) * (points[:, 1] - ay) - (by - ay) * (points[:, 0] - ax) > 0
    return np.flatnonzero(~inside)


def hull(points: np.ndarray) -> np.ndarray:
    """Row numbers of the hull's corners, counter-clockwise from the least point; fewer than 3 points are kept."""
    some = _outside(points) if len(points) > 4 * DIRECTIONS else np.arange(len(points))
    order = some[np.lexsort((points[some, 1], points[some, 0]))]
    if len(order) < 3:
        return order

    def chain(rows) -> list[int]:  # noqa: ANN001
        out: list[int] = []
        for r in rows:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[out[-2]], points[out[-1]], points[r]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(int(r))
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1] or lower[:1])


def hulls(points: DataFrame, x: str, y: str, cluster: str = "cluster_id", key: str = "instance", duration: str = "duration", noise: int = 0, near: str | None = None) -> DataFrame:
    """A hull per cluster without noise. Each task passes on the hulls of its own points, of which few corners are left, and the hull of those is the cluster's.

    ``near`` is a column with the size of each point's neighbourhood (F8), kept with the corners; 0 without it.
    """
    rows = points.where(F.col(cluster) != noise).select(F.col(cluster).cast("long").alias("cluster_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(key).cast("long").alias("instance"),
                                                        (F.col(near) if near else F.lit(0)).cast("long").alias("near"), F.coalesce(F.col(duration).cast("long"), F.lit(0)).alias("d")).dropna(subset=["x", "y"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            cluster_of, *own, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            own = np.rec.fromarrays(own, names="x,y,i,n")
            order = np.argsort(cluster_of, kind="stable")
            kinds, first = np.unique(cluster_of[order], return_index=True)
            for c, rows_of in zip(kinds.tolist(), np.split(order, first[1:])):
                part = own[rows_of]
                xy = np.stack([part.x, part.y], 1)
                part = part[_kept(xy, part.i)]
                if c in held:
                    part = np.concatenate([held[c][0], part]).view(np.recarray)
                    part = part[_kept(np.stack([part.x, part.y], 1), part.i)]
                    held[c] = [part, held[c][1] + len(rows_of), held[c][2] + int(d[rows_of].sum())]
                else:
                    held[c] = [part, len(rows_of), int(d[rows_of].sum())]
        if held:
            lists = pa.array([[{"x": float(p.x), "y": float(p.y), "instance": int(p.i), "near": int(p.n)} for p in h[0]] for h in held.values()], pa.list_(CORNER_TYPE))
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h[1] for h in held.values()]), pa.array([h[2] for h in held.values()]), lists], ["cluster_id", "density", "total_time", "points"])

    def final(t: pa.Table) -> pa.Table:
        flat = pa.concat_arrays(t.column("points").chunks).flatten()
        at = _kept(np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1), flat.field("instance").to_numpy(zero_copy_only=False))
        total = lambda c: pa.array([sum(t.column(c).to_pylist())], pa.int64())
        return pa.table({"cluster_id": pa.array([t.column("cluster_id")[0].as_py()], pa.int64()), "density": total("density"), "total_time": total("total_time"),
                         "points": pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), flat.take(pa.array(at)))})

    return rows.mapInArrow(partial, HULL).groupBy("cluster_id").applyInArrow(final, HULL)


CORNER_TYPE = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("instance", pa.int64()), ("near", pa.int64())])


def _kept(xy: np.ndarray, instance: np.ndarray) -> np.ndarray:
    """Row numbers of the hull's corners in order; of equal points the one of the least instance."""
    order = np.lexsort((instance, xy[:, 1], xy[:, 0]))
    order = order[np.r_[True, (xy[order[1:]] != xy[order[:-1]]).any(1)]]
    return order[hull(xy[order])]


def _inside(px, py, points):  # noqa: ANN001, ANN202
    """Inside or on the boundary of a counter-clockwise polygon."""
    nxt = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    edges = F.arrays_zip(points.alias("a"), nxt.alias("b"))
    return (F.size(points) >= 3) & F.forall(edges, lambda e: (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (px - e["a"]["x"]) >= 0)


def classify(points: DataFrame, model: DataFrame, x: str, y: str, key: str = "instance", eps: float = 0.0, min_points: int = 0, near: str | None = None) -> DataFrame:
    """(key, cluster_id) of the first hull (least id) that holds a point, 0 without one; a null coordinate gives 0.

    With ``eps`` a point in no hull goes to the hull whose nearest corner is nearest, if that lies within eps and
    the corner's neighbourhood, the point's (``near``) and 1 make ``min_points``; ties go to the first hull. A model of
    at most SHIPPED_CORNERS corners, as it is after ``global_model``, is sent along with the tasks and tested hull by
    hull over whole batches. A larger one meets the points through grid joins.
    """
    kind = dict(points.dtypes)[key]
    rows = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.coalesce(F.col(near) if near else F.lit(0), F.lit(0)).cast("long").alias("_near"))
    corners = model.agg(F.sum(F.size("points"))).first()[0] or 0
    if corners > SHIPPED_CORNERS:
        return _classify_by_grid(rows, model, eps, min_points).withColumnRenamed("key", key)
    own = [(r["cluster_id"], np.array([[p["x"], p["y"]] for p in r["points"]]), np.array([p["near"] for p in r["points"]])) for r in model.orderBy("cluster_id").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py, pn = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            found = np.zeros(len(px), np.int64)
            for number, p, _ in own:
                if len(p) < 3:
                    continue
                low, high = p.min(0), p.max(0)
                at = np.flatnonzero((found == 0) & (px >= low[0]) & (px <= high[0]) & (py >= low[1]) & (py <= high[1]))
                for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
                    at = at[(bx - ax) * (py[at] - ay) - (by - ay) * (px[at] - ax) >= 0]
                found[at] = number
            if eps > 0:
                rest = np.flatnonzero(found == 0)
                least = np.full(len(rest), np.inf)
                for number, p, n in own:
                    d2 = (px[rest, None] - p[None, :, 0]) ** 2 + (py[rest, None] - p[None, :, 1]) ** 2
                    corner = d2.argmin(1)
                    d2 = d2[np.arange(len(rest)), corner]
                    ok = (d2 <= eps * eps) & (d2 < least) & (n[corner] + pn[rest] + 1 >= min_points)
                    found[rest[ok]], least[ok] = number, d2[ok]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["key", "cluster_id"])

    return rows.mapInArrow(run, f"key {kind}, cluster_id long").withColumnRenamed("key", key)


def _classify_by_grid(rows: DataFrame, model: DataFrame, eps: float, min_points: int) -> DataFrame:
    """The plane is cut into GRID x GRID cells of the model's range; a hull is listed in the cells its box covers."""
    flat = model.select(
        "cluster_id", "points", F.array_min(F.transform("points", lambda p: p["x"])).alias("x0"), F.array_max(F.transform("points", lambda p: p["x"])).alias("x1"),
        F.array_min(F.transform("points", lambda p: p["y"])).alias("y0"), F.array_max(F.transform("points", lambda p: p["y"])).alias("y1"))
    lim = flat.agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    at = lambda c, low, high: F.floor((c - low) / ((high - low) or 1.0) * GRID).cast("int")
    listed = flat.withColumn("_i", F.explode(F.sequence(at(F.col("x0"), lim[0], lim[1]), at(F.col("x1"), lim[0], lim[1])))).withColumn(
        "_j", F.explode(F.sequence(at(F.col("y0"), lim[2], lim[3]), at(F.col("y1"), lim[2], lim[3]))))
    placed = rows.withColumn("_i", at(F.col("_x"), lim[0], lim[1])).withColumn("_j", at(F.col("_y"), lim[2], lim[3]))
    hit = placed.join(listed, ["_i", "_j"]).where(_inside(F.col("_x"), F.col("_y"), F.col("points"))).groupBy("key").agg(F.min("cluster_id").alias("cluster_id"))
    if eps > 0:
        corner = model.select("cluster_id", F.inline("points")).select(F.struct("cluster_id", "near", "x", "y").alias("id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        asked = rows.join(hit, "key", "left_anti").select(F.struct("key", "_near").alias("id"), "_x", "_y")
        close = radius_pairs(asked, corner, ["_x", "_y"], eps, small=True).select("id.key", "id._near", "other.cluster_id", "other.near", "d2")
        close = close.groupBy("key", "_near", "cluster_id").agg(F.min("d2").alias("d2"), F.min_by("near", "d2").alias("near")).where(F.col("near") + F.col("_near") + 1 >= min_points)
        hit = hit.unionByName(close.groupBy("key").agg(F.min_by("cluster_id", F.struct("d2", "cluster_id")).alias("cluster_id")))
    return rows.select("key").join(hit, "key", "left").select("key", F.coalesce("cluster_id", F.lit(0)).cast("long").alias("cluster_id"))


def overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Two convex polygons (counter-clockwise, or fewer than 3 points) meet: no edge direction separates them."""
    for p, q in ((a, b), (b, a)):
        edge = np.roll(p, -1, axis=0) - p if len(p) > 1 else np.zeros((0, 2))
        for n in np.stack([-edge[:, 1], edge[:, 0]], 1):
            u, v = p @ n, q @ n
            if u.max() < v.min() or v.max() < u.min():
                return False
    both = np.vstack([a, b])
    for n in np.eye(2):
        if (a @ n).max() < (b @ n).min() or (b @ n).max() < (a @ n).min():
            return False
    return len(both) > 0


def _near(a: dict, b: dict, eps: float, min_points: int) -> bool:
    """Two corners lie within eps and their neighbourhoods (one whole, the other half) and 1 make ``min_points``."""
    p, q = a["points"], b["points"]
    close = ((p[:, None] - q[None]) ** 2).sum(2) <= eps * eps
    return bool((close & (a["near"][:, None] + b["near"][None] // 2 + 1 >= min_points)).any())


def merge(models: Sequence[dict], eps: float = 0.0, min_points: int = 0) -> list[dict]:
    """Hulls (points, density, total_time, and near for each point) that meet, or are near each other, become the hull of their union, until none does.

    A model is a few hulls of a few corners each; this runs where a level of the tree is merged.
    """
    left: list[dict] = []
    for m in models:
        own = dict(m, points=np.asarray(m["points"], float), near=np.asarray(m.get("near", np.zeros(len(m["points"]), int))))
        i = 0
        while i < len(left):
            other = left[i]
            if overlap(own["points"], other["points"]) or (eps > 0 and _near(own, other, eps, min_points)):
                points, near = np.vstack([own["points"], other["points"]]), np.r_[own["near"], other["near"]]
                at = hull(points)
                own = {"points": points[at], "near": near[at], "density": own["density"] + other["density"], "total_time": own["total_time"] + other["total_time"]}
                del left[i]
                i = 0  # the larger hull may meet those passed over
            else:
                i += 1
        left.append(own)
    return left


def tree_clustering(points: DataFrame, x: str, y: str, backend: str, eps: float, min_points: int, fan_in: int = 2, key: str = "instance", duration: str = "duration") -> tuple[DataFrame, DataFrame]:
    """C16-C19 as one run: (cluster model, (key, cluster_id) of all points).

    The points of each backend (numbered from 0) are clustered by themselves; going up, up to ``fan_in``
    neighbouring nodes become one, their noise is pooled and clustered again with the level's MinPts (C18), and
    their hulls are merged (C17). At the root hulls of ``min_points`` bursts are kept by time (C19), and every point
    is classified by them (J15). Nodes are kept apart by a third coordinate. To the driver come hulls, one per cluster.
    """
    own = cut(points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(backend).cast("long").alias("_node"), F.col(duration).alias("_d")).dropna(subset=["x", "y"]), "tree")
    dims, noise, width, found = ["x", "y", "_b"], own, 1, {}
    most = own.agg(F.max("_node")).first()[0]
    level = 0
    while most is not None:
        node = F.floor(F.col("_node") / width)
        apart = noise.withColumn("_b", node * 4 * float(eps))
        least = min_points if not level else level_min_points(min_points, fan_in)
        labels = cut(apart.join(dbscan(apart.select("id", *dims), dims, eps, least), "id"), "level")
        model = hulls(labels, "x", "y", key="id", duration="_d")
        corners = model.select("cluster_id", F.inline("points")).join(labels.where("cluster_id > 0").groupBy("cluster_id").agg(F.min("_b").alias("_b")), "cluster_id")
        counted = radius_pairs(corners.select(F.col("instance").alias("id"), *dims), apart.select("id", *dims), dims, eps, small=True).groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n"))
        near = {r["id"]: r["n"] for r in counted.collect()}  # corners of one model
        places = {r["cluster_id"]: int(r["n"]) for r in labels.where("cluster_id > 0").groupBy("cluster_id").agg(F.min(node).alias("n")).collect()}
        grouped: dict[int, list[dict]] = {}
        for n, models in found.items():
            grouped.setdefault(n // fan_in if level else n, []).extend(models)
        for r in model.orderBy("cluster_id").collect():
            grouped.setdefault(places[r["cluster_id"]], []).append(
                {"points": [[p["x"], p["y"]] for p in r["points"]], "near": [near.get(p["instance"], 0) for p in r["points"]], "density": r["density"], "total_time": r["total_time"]})
        found = {n: merge(models, eps, least) if level else models for n, models in grouped.items()}
        noise = labels.where("cluster_id = 0").select(*own.columns)
        if most // width == 0:
            break
        width, level = width * fan_in, level + 1
    kept = sorted((m for models in found.values() for m in models if m["density"] >= min_points), key=lambda m: -m["total_time"])
    rows = [(i, int(m["density"]), int(m["total_time"]), [(float(a), float(b), -1, int(n)) for (a, b), n in zip(np.asarray(m["points"]), m["near"])]) for i, m in enumerate(kept, 1)]
    model = points.sparkSession.createDataFrame(rows, HULL)
    return model, classify(points, model, x, y, key, eps, min_points)


def global_model(model: DataFrame, min_points: int) -> DataFrame:
    """Hulls of at least min_points bursts by total time."""
    return model.where(F.col("density") >= min_points).orderBy(F.desc("total_time"), "cluster_id")


def level_min_points(min_points: int, siblings: int) -> int:
    """MinPts of a level of the merge tree."""
    return max(3, min_points // max(1, siblings))


def support_grid(points: DataFrame, x: str, y: str, backend: str, key: str = "instance") -> DataFrame:
    """C20: per row, on how many backends its cell of a GRID x GRID grid over the range is occupied."""
    lim = one_row(points, x0=F.min(x), x1=F.max(x), y0=F.min(y), y1=F.max(y))
    at = lambda c, a, b: F.when(lim[b] == lim[a], 0).otherwise(F.least(F.floor((F.col(c) - lim[a]) / (lim[b] - lim[a]) * GRID), F.lit(GRID - 1))).cast("int")
    placed = points.select(key, backend, at(x, "x0", "x1").alias("cell_x"), at(y, "y0", "y1").alias("cell_y"))
    counts = placed.groupBy("cell_x", "cell_y").agg(F.countDistinct(backend).alias("support"))
    return placed.join(counts, ["cell_x", "cell_y"]).select(key, "cell_x", "cell_y", "support")
