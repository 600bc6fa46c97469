"""Neighbour joins over points: radius, k nearest, nearest sample, and what follows from k-distances.

A point has an ``id`` and numeric coordinate columns. Points meet through grid cells: for a radius the cell is
as wide as the radius and a point looks into the 3^d cells around it (of the first GRID_DIMS dimensions), which
is an equi-join. Copies of a point are folded first, so that a cell full of equal points gives no square of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import cut

GRID_DIMS = 3
#: Ids of equal points in one list at most; parts into which the points of a cell are dealt.
LIST, SALTS = 256, 8


def cell(column: str, width: float) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def squared(dims: Sequence[str], a: str, b: str) -> Column:
    """Sum of squared differences, in the order of the dimensions on both sides of any comparison."""
    return reduce(lambda s, x: s + x, [(F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) * (F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) for d in dims])


def radius_pairs(points: DataFrame, others: DataFrame, dims: Sequence[str], eps: float, strict: bool = False, keep: Sequence[str] = (), salts: int = 1, small: bool = False) -> DataFrame:
    """(id, other, d2, and ``keep`` of the others) with squared distance at most eps^2 (below it if ``strict``), a point itself included.

    Rows with a null coordinate have no neighbours. The result has one row per pair of rows: give distinct
    points where copies abound. Points of a cell are spread over ``salts`` tasks. The join merges sorted rows: the
    sizes that decide on a broadcast are those of compressed files and don't count the 3^d cells. Unless one side is ``small``.
    """
    grid = dims[:GRID_DIMS]
    a, b = points.dropna(subset=list(dims)), others.dropna(subset=list(dims))
    keys = [f"_c_{d}" for d in grid]
    for d in grid:
        at = cell(d, eps)
        a = a.withColumn(f"_c_{d}", F.explode(F.array(at - 1, at, at + 1)))
        b = b.withColumn(f"_c_{d}", at)
    if salts > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64("id", *dims), F.lit(salts)).cast("int"))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    a, b = a.alias("a"), b.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    d2 = squared(dims, "a", "b")
    bound = F.lit(float(eps) * float(eps))
    met = (a if small else a.hint("merge")).join(b, reduce(lambda x, y: x & y, same))
    return met.where(d2 < bound if strict else d2 <= bound).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), d2.alias("d2"), *[F.col(f"b.{c}").alias(c) for c in keep])


def listed(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct points: coordinates and, as id, the list of the ids of its rows, in pieces of at most LIST."""
    none = F.array_repeat(F.lit(None).cast(points.schema["id"].dataType), (F.count(F.lit(1)) - F.count("id")).cast("int"))
    own = points.dropna(subset=list(dims)).groupBy(*dims).agg(F.concat(F.collect_list("id"), none).alias("id"))
    return own.withColumn("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("id"), F.lit(LIST)), lambda i: F.slice("id", i, LIST))))


def row_pairs(points: DataFrame, dims: Sequence[str], eps: float, digits: int) -> DataFrame:
    """J12 of a table with itself: (id, other, d2 rounded) of all pairs of rows within eps.

    Distances are taken and rounded once for each pair of distinct points; the rows of both are listed beside them and
    written out last, in the same tasks, so that nothing of the size of the result is sorted or shuffled.
    """
    own = cut(listed(points, dims), "listed")
    met = radius_pairs(own, own, dims, eps, salts=SALTS).select("id", "other", F.round("d2", digits).alias("d2"))
    # generated code holds all that comes of one row at once: coalesce, which joins no tasks here, ends it between pairs and their rows
    pairs = met.coalesce(1 << 20)
    return pairs.select(F.explode("id").alias("id"), "other", "d2").select("id", F.explode("other").alias("other"), "d2")


def folded(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct points: id (the least of its copies), coordinates and the number of copies."""
    return points.groupBy(*dims).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def neighbour_counts(points: DataFrame, dims: Sequence[str], eps: float) -> DataFrame:
    """id, neighbours: points within eps of each point, itself included."""
    own = cut(folded(points, dims), "folded")
    counted = radius_pairs(own, own, dims, eps).join(own.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("neighbours"))
    return points.select("id", *dims).join(own.join(counted, "id").drop("id", "copies"), list(dims)).select("id", "neighbours")


# ---------------------------------------------------------------- k nearest


def k_nearest(queries: DataFrame, points: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    """(id, other, d2, rank) of the k nearest points of each query, itself included if it is a point; ties by id.

    Rows with a null coordinate are left out; fewer than k points give fewer rows. Space is halved level by
    level. The finest cell around a query that holds k points bounds the distance of its k-th neighbour by the
    cell's diagonal, which is at most the width one level up: the query's k nearest lie in the 3^d cells around it
    there. So queries meet points by an equi-join of cells, each at a level that suits the density around it. Of
    equal points only the k of least id can be among the nearest; others are left out first.
    """
    if len(dims) > GRID_DIMS:
        raise ValueError(f"at most {GRID_DIMS} dimensions")
    at = [f"_x{i}" for i in range(len(dims))]
    coded = lambda df, name: df.dropna(subset=list(dims)).select(F.col("id").alias(name), *[F.col(d).cast("double").alias(x) for d, x in zip(dims, at)])
    copies = Window.partitionBy(*at).orderBy("other")
    own = cut(coded(points, "other").withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k).drop("_n"), "points")
    asked = cut(coded(queries, "id"), "queries")
    box = own.select(*at).unionByName(asked.select(*at)).agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(n + x) for x in at for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if not box["n"]:
        return asked.join(own, F.lit(False)).select("id", "other", F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    low = [box["lo" + x] for x in at]
    width = max([box["hi" + x] - v for x, v in zip(at, low)]) * (1 + 1e-9) or 1.0
    finest = int(math.log2(max(box["n"], 2)) / len(dims)) + 3
    cells = ["_level", *[f"_c{i}" for i in range(len(dims))]]

    def cell_at(level: Column, add: Sequence[Column] | None = None) -> list[Column]:
        size = F.lit(width) / F.pow(F.lit(2.0), level)
        found = [F.floor((F.col(x) - v) / size).cast("long") for x, v in zip(at, low)]
        return [(c if add is None else c + add[i]).alias(f"_c{i}") for i, c in enumerate(found)]

    levels = F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("_level")
    in_cells = lambda df, *keep: df.select(*keep, *at, levels).select(*keep, *at, "_level", *cell_at(F.col("_level")))
    full = in_cells(own).groupBy(*cells).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
    leveled = in_cells(asked, "id").join(full, cells, "left_semi").groupBy("id", *at).agg(F.max("_level").alias("_level"))
    leveled = asked.join(leveled.select("id", "_level"), "id", "left").withColumn("_level", F.greatest(F.coalesce("_level", F.lit(0)) - 1, F.lit(0)))
    around = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(offset)]) for offset in product((-1, 0, 1), repeat=len(dims))])
    looks = leveled.withColumn("_o", F.explode(around))
    looks = cut(looks.select("id", *[F.col(x).alias(f"q{x}") for x in at], "_level", *cell_at(F.col("_level"), [F.col(f"_o.o{i}") for i in range(len(dims))])), "looks")
    met = in_cells(own, "other").join(looks.select(*cells).distinct(), cells, "left_semi")
    near = looks.join(met, cells).select("id", "other", reduce(lambda s, x: s + x, [(F.col(f"q{x}") - F.col(x)) * (F.col(f"q{x}") - F.col(x)) for x in at]).alias("d2"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))).where(F.col("rank") <= k)


def k_distances(points: DataFrame, dims: Sequence[str], k_begin: int, k_end: int, queries: DataFrame | None = None) -> DataFrame:
    """(k, id, dist) to the k-th neighbour, the point itself not counted, for k in [k_begin, k_end]."""
    near = k_nearest(points if queries is None else queries, points, dims, k_end + 1)
    return near.where(F.col("rank") > k_begin).select((F.col("rank") - 1).alias("k"), "id", F.sqrt("d2").alias("dist"))


def nearest_label(rows: DataFrame, samples: DataFrame, dims: Sequence[str], eps: float, cluster: str = "cluster_id", noise: int = 0) -> DataFrame:
    """(id, cluster) of the nearest sample closer than eps, ties by the sample's id, else noise.

    Distinct points meet distinct samples, of equal ones that of the least id; all rows of a point then take its sample.
    """
    own = cut(listed(rows, dims), "rows")
    known = samples.dropna(subset=list(dims)).groupBy(*dims).agg(F.min(F.struct("id", F.col(cluster).alias("_label"))).alias("_s")).select(*dims, "_s.*")
    points = own.select(*dims).distinct().select(F.struct(*dims).alias("id"), *dims)
    pairs = radius_pairs(points, known, dims, eps, strict=True, keep=["_label"])
    best = pairs.groupBy("id").agg(F.min(F.struct("d2", "other", "_label")).alias("best")).select("id.*", "best")
    labelled = own.join(best.hint("merge"), list(dims)).select(F.explode("id").alias("id"), "best")
    labelled = labelled.groupBy("id").agg(F.min("best").alias("best")).select("id", "best._label")
    return rows.select("id").join(labelled.hint("merge"), "id", "left").select("id", F.coalesce("_label", F.lit(noise)).alias(cluster))


def auto_epsilon(distances: DataFrame, values: int = 10) -> DataFrame:
    """Eps candidates from k-distances (column dist): between the first half percent and the knee of the descending curve.

    The curve is ranked by range partitions; only the few ranks that are asked for are kept.
    """
    from quillon.operators.ranks import ranked

    curve = ranked(distances.select(F.col("dist"), (-F.col("dist")).alias("_neg")), [], ["_neg"]).select((F.col("_rank") - 1).alias("i"), "dist")
    curve = cut(curve, "curve")
    n = curve.count()
    if not n:
        return curve.select(F.lit(1).alias("step"), F.col("dist").alias("eps")).limit(0)
    low, high = n * 5 // 1000, n * 995 // 1000
    middle = max(high // 2, 1)
    top = curve.where(F.col("i") == low).first()["dist"]
    line = F.lit(top) - F.lit(top / middle) * F.col("i")
    knee = curve.where(F.col("i").between(low, middle)).agg(F.max(F.struct((line - F.col("dist")).alias("gap"), (-F.col("i")).alias("neg"))).alias("m")).first()["m"]
    at = -knee["neg"] if knee else low
    span = at - low
    picks = [low + i * span // values for i in range(1, values + 1)] if span >= values else list(range(low, at + 1))
    steps = F.array_position(F.array(*[F.lit(p) for p in picks]), F.col("i"))
    return curve.where(F.col("i").isin(picks)).select(steps.cast("int").alias("step"), F.col("dist").alias("eps"))
