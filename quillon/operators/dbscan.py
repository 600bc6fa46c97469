"""Density clustering with the ids of a sequential scan, computed without an order of visits.

Points lie in cells so small that all points of one are neighbours. A cell with enough points makes them core
points without a look at any pair; cells are linked by a few outer points of each, and only pairs of cells that
may touch and aren't linked that way, even by detours, are compared point by point.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import components
from quillon.operators.neighbors import GRID_DIMS, cell, folded, radius_pairs
from quillon.operators.ranks import ranked
from quillon.runtime import cut, dim_join


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _outer(dims: Sequence[str]) -> list[Column]:
    """The outermost points of a group in the directions of the axes and the diagonals."""
    directions = [v for v in product((-1, 0, 1), repeat=len(dims)) if any(v) and (sum(map(abs, v)) in (1, len(dims)))]
    return [F.max_by(F.struct(*dims), _sum([F.col(d) * float(s) for d, s in zip(dims, v)])) for v in directions]


def _linked_cells(core: DataFrame, dims: Sequence[str], eps: float) -> tuple[DataFrame, DataFrame]:
    """Cells with the least core point of their cluster (``start``), and core points with it. ``core`` has id, dims and the cell columns."""
    cells = [f"_f_{d}" for d in dims]
    bound = float(eps) * float(eps)
    of_cell = cut(core.groupBy(*cells).agg(F.min("id").alias("node"), F.array(*_outer(dims)).alias("outer"), *[f(d).alias(n + d) for d in dims for n, f in (("lo_", F.min), ("hi_", F.max))]), "cells")
    reach = [o for o in product(range(-2, 3), repeat=len(dims)) if o > (0,) * len(dims) and sum(max(abs(x) - 1, 0) ** 2 for x in o) <= len(dims)]
    around = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in reach]))
    side = lambda n: of_cell.select(F.col("node").alias(n), F.col("outer").alias(f"outer_{n}"), *[F.col(k + d).alias(f"{k}{d}_{n}") for d in dims for k in ("lo_", "hi_")], *cells)
    a = side("a").withColumn("_o", around)
    a = a.withColumns({c: F.col(c) + F.col(f"_o.o{i}") for i, c in enumerate(cells)}).drop("_o")
    apart = [F.greatest(F.col(f"lo_{d}_a") - F.col(f"hi_{d}_b"), F.col(f"lo_{d}_b") - F.col(f"hi_{d}_a"), F.lit(0.0)) for d in dims]
    touch = F.exists("outer_a", lambda x: F.exists("outer_b", lambda y: _sum([(x[d] - y[d]) * (x[d] - y[d]) for d in dims]) <= bound))
    pairs = a.join(side("b"), cells).where(_sum([x * x for x in apart]) <= bound * (1 + 1e-9))
    pairs = cut(pairs.select("a", "b", *[f"{k}{d}_{n}" for d in dims for k in ("lo_", "hi_") for n in "ab"], touch.alias("sure")), "cell-pairs")
    alone = of_cell.select(F.col("node").alias("a"), F.col("node").alias("b"))
    roots = cut(components(pairs.where("sure").select("a", "b").unionByName(alone)), "roots")
    named = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
    open_pairs = cut(pairs.where("not sure").join(named("a"), "a").join(named("b"), "b").where("root_a <> root_b").drop("sure"), "open-pairs")
    if not open_pairs.isEmpty():
        own = core.join(of_cell.select("node", *cells), cells).select("node", *dims)
        box = lambda n, d, x: F.greatest(F.col(f"lo_{d}_{n}") - x, x - F.col(f"hi_{d}_{n}"), F.lit(0.0))

        def near(n: str, other: str) -> DataFrame:
            """Points of one cell of each open pair that lie within eps of the other cell's box."""
            met = open_pairs.join(own.withColumnRenamed("node", n), n)
            gap = [box(other, d, F.col(d)) for d in dims]
            return met.where(_sum([g * g for g in gap]) <= bound * (1 + 1e-9)).select("a", "b", "root_a", "root_b", *[F.col(d).alias(f"{d}_{n}") for d in dims])

        close = _sum([(F.col(f"{d}_a") - F.col(f"{d}_b")) * (F.col(f"{d}_a") - F.col(f"{d}_b")) for d in dims]) <= bound
        found = near("a", "b").join(near("b", "a").drop("root_a", "root_b"), ["a", "b"]).where(close).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        joined = components(found).select(F.col("node").alias("root"), F.col("root").alias("_top"))
        roots = cut(roots.join(joined, "root", "left").select("node", F.coalesce("_top", "root").alias("root")), "roots")
    started = of_cell.select("node", *cells).join(roots.select("node", F.col("root").alias("start")), "node").drop("node")
    return started, dim_join(core, started, cells).select("id", *dims, "start")


def dbscan(points: DataFrame, dims: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """(id, cluster_id), clusters from 1 by their least core id, noise 0.

    Core points have at least ``min_points`` points within eps, themselves included; components of core
    points are clusters. A border point goes to the largest candidate cluster whose first core point lies
    within eps, if there is one, else to the least candidate. Rows with a null coordinate are noise. Equal
    points are folded first. Points of cells with too few points are counted against their surroundings; border
    points, which have few neighbours, are the only ones whose pairs are listed. At most GRID_DIMS dimensions.
    """
    if len(dims) > GRID_DIMS:
        raise ValueError(f"at most {GRID_DIMS} dimensions")
    width = eps / len(dims) ** 0.5 * (1 - 1e-6)
    cells = [f"_f_{d}" for d in dims]
    own = folded(points.dropna(subset=list(dims)), dims)
    own = cut(own.withColumns({f"_f_{d}": cell(d, width) for d in dims}), "folded")
    full = own.groupBy(*cells).agg(F.sum("copies").alias("_n")).where(F.col("_n") >= min_points).drop("_n")
    dense = own.join(full, cells, "left_semi")
    thin = cut(own.join(full, cells, "left_anti"), "thin")
    pairs = radius_pairs(thin.select("id", *dims), own.select("id", *dims, "copies"), dims, eps, keep=["copies"])
    counted = pairs.groupBy("id").agg((F.sum("copies") >= min_points).alias("_core"))
    thin = cut(thin.join(counted, "id"), "counted")
    core = dense.unionByName(thin.where("_core").drop("_core")).select("id", *dims, *cells)
    roots, of_core = _linked_cells(core, dims, eps)
    starts = ranked(roots.select("start").distinct(), [], ["start"], "number").select("start", F.col("number").cast("int").alias("cluster_id"))
    assigned = cut(dim_join(of_core, starts, ["start"]), "assigned")
    border = thin.where("not _core")
    near = radius_pairs(border.select("id", *dims), assigned, dims, eps, keep=["start", "cluster_id"])
    first = F.max(F.when(F.col("other") == F.col("start"), F.col("cluster_id")))
    labels = assigned.select("id", "cluster_id").unionByName(near.groupBy("id").agg(F.coalesce(first, F.min("cluster_id")).alias("cluster_id")))
    known = own.join(labels, "id").select(*[F.col(d).alias(f"_k_{d}") for d in dims], "cluster_id")
    match = [points[d] == known[f"_k_{d}"] for d in dims]
    return points.join(known, match, "left").select(points["id"], F.coalesce(known["cluster_id"], F.lit(0)).alias("cluster_id"))
