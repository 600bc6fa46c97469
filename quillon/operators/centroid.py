"""Centroid clustering: k-means steps, G-means with its normality test, and medoids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.metrics import normal_cdf
from quillon.operators.ranks import ranked
from quillon.runtime import cut

#: Critical values of the test for normality by significance in percent.
CRITICAL = {15.0: 0.576, 10.0: 0.656, 5.0: 0.787, 2.5: 0.918, 1.0: 1.092}


def critical_value(percent: float) -> float:
    """The value of the nearest significance listed."""
    return CRITICAL[min(CRITICAL, key=lambda p: abs(p - percent))]


def assign(points: DataFrame, dims: Sequence[str], centres: Sequence[Sequence[float]], weights: str | None = None) -> DataFrame:
    """Each point with the number (from 0) of its nearest centre, ties to the first; the centres are a short list in the plan."""
    best = None
    for i, c in enumerate(centres):
        d2 = sum(((F.col(d) - float(v)) * (F.col(d) - float(v)) for d, v in zip(dims, c)), F.lit(0.0))
        here = F.struct(d2.alias("d2"), F.lit(i).alias("centre"))
        best = here if best is None else F.least(best, here)
    return points.withColumn("_best", best).withColumn("centre", F.col("_best.centre")).withColumn("d2", F.col("_best.d2")).drop("_best")


def update(assigned: DataFrame, dims: Sequence[str]) -> DataFrame:
    """New centres: the mean of each one's points."""
    return assigned.groupBy("centre").agg(*[F.avg(d).alias(d) for d in dims], F.count(F.lit(1)).alias("n"))


def lloyd(points: DataFrame, dims: Sequence[str], centres: list[list[float]], rounds: int = 100, moved: float = 0.01) -> list[list[float]]:
    """k-means from given centres until less than ``moved`` of the points change theirs; an empty centre stays."""
    before = None
    total = points.count()
    for _ in range(rounds):
        here = assign(points, dims, centres)
        if before is not None:
            change = F.sum((F.col("centre") != F.col("_was")).cast("long"))
            changed = assign(points, dims, before).withColumnRenamed("centre", "_was").drop("d2")
            if (assign(changed, dims, centres).agg(change).first()[0] or 0) < moved * total:
                break
        means = {r["centre"]: [r[d] for d in dims] for r in update(here, dims).collect()}  # one row per centre
        before, centres = centres, [means.get(i, c) for i, c in enumerate(centres)]
    return centres


def anderson_darling(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, statistic) of the test for normality with estimated mean and deviation.

    Values are ranked within groups by range partitions; the i-th and the (n+1-i)-th meet in a join. A group
    of fewer than 2 values, or of equal ones, has a null statistic.
    """
    moments = values.groupBy(group).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    order = cut(ranked(values.where(F.col(value).isNotNull()).select(group, value), [group], [value]), "ranked")
    z = order.join(moments, group).withColumn("_cdf", normal_cdf((F.col(value) - F.col("_m")) / F.col("_s")))
    z = z.withColumn("_cdf", F.least(F.greatest("_cdf", F.lit(1e-12)), F.lit(1 - 1e-12)))
    i, n = F.col("_rank"), F.col("_n")
    # each value stands once at its own rank and once at the mirrored one
    own = (2 * i - 1) * F.log("_cdf")
    mirrored = (2 * (n + 1 - i) - 1) * F.log(1 - F.col("_cdf"))
    stat = z.groupBy(group).agg(F.max("_n").alias("n"), (-F.max("_n") - F.sum(own + mirrored) / F.max("_n")).alias("statistic"), F.max("_s").alias("_s"))
    return stat.select(group, "n", F.when((F.col("n") > 1) & (F.col("_s") > 0), F.col("statistic")).alias("statistic"))


def gmeans(points: DataFrame, dims: Sequence[str], critical: float, most: int = 30) -> DataFrame:
    """(id, cluster_id) by k-means whose centres split until their points look normal along the split.

    Starts from the two points of least id; ids count from 1. Each round tests all centres at once: a 2-means
    inside each, then the normality of the projection on the line between the two.
    """
    rows = points.dropna(subset=list(dims))
    first = rows.orderBy("id").limit(2).select(*dims).collect()
    if not first:
        return points.select("id", F.lit(0).alias("cluster_id"))
    centres = [[float(x) for x in r] for r in first]
    while True:
        centres = lloyd(rows, dims, centres)
        own = cut(assign(rows, dims, centres).select("id", *dims, "centre"), "assigned")
        spread = {r["centre"]: [r[f"s_{d}"] or 0.0 for d in dims] for r in own.groupBy("centre").agg(*[F.stddev_samp(d).alias(f"s_{d}") for d in dims]).collect()}
        halves = {}
        for c, s in spread.items():
            k = int(np.argmax(s))
            shift = np.zeros(len(dims))
            shift[k] = s[k]
            halves[c] = [(np.array(centres[c]) - shift).tolist(), (np.array(centres[c]) + shift).tolist()]
        for _ in range(10):
            side = _sides(own, dims, halves)
            means = {(r["centre"], r["side"]): [r[d] for d in dims] for r in side.groupBy("centre", "side").agg(*[F.avg(d).alias(d) for d in dims]).collect()}
            halves = {c: [means.get((c, i), h[i]) for i in (0, 1)] for c, h in halves.items()}
        line = {c: np.array(h[1]) - np.array(h[0]) for c, h in halves.items()}
        project = F.coalesce(*[F.when(F.col("centre") == c, sum((F.col(d) * float(v) for d, v in zip(dims, w)), F.lit(0.0))) for c, w in line.items()])
        tests = {r["centre"]: r["statistic"] for r in anderson_darling(own.withColumn("_p", project), "centre", "_p").collect()}
        split = [c for c in sorted(tests) if tests[c] is not None and tests[c] >= critical]
        if not split or len(centres) >= most:
            return points.select("id").join(own.select("id", (F.col("centre") + 1).alias("cluster_id")), "id", "left").select("id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))
        split = split[:most - len(centres)]
        centres = [x for i, c in enumerate(centres) for x in (halves[i] if i in split else [c])]


def _sides(own: DataFrame, dims: Sequence[str], halves: dict[int, list[list[float]]]) -> DataFrame:
    d2 = lambda h: sum(((F.col(d) - float(v)) * (F.col(d) - float(v)) for d, v in zip(dims, h)), F.lit(0.0))
    side = F.coalesce(*[F.when(F.col("centre") == c, (d2(h[1]) < d2(h[0])).cast("int")) for c, h in halves.items()])
    return own.withColumn("side", side)


# ---------------------------------------------------------------- medoids


def pam(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Medoids (row numbers) by greedy build and best swaps over one block of points; cost is the sum of distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    medoids = [int(d.sum(0).argmin())]
    while len(medoids) < min(k, len(x)):
        near = d[:, medoids].min(1)
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    cost = d[:, medoids].min(1).sum()
    while True:
        best = None
        for i in range(len(medoids)):
            rest = [m for j, m in enumerate(medoids) if j != i]
            base = d[:, rest].min(1) if rest else np.full(len(x), np.inf)
            totals = np.minimum(base[:, None], d).sum(0)
            j = int(totals.argmin())
            if totals[j] < cost - 1e-12 and (best is None or totals[j] < best[0]):
                best = (totals[j], i, j)
        if best is None:
            return np.array(medoids), float(cost)
        cost, medoids[best[1]] = best[0], best[2]


def clara(points: DataFrame, dims: Sequence[str], k: int, samples: int = 5, size: int = 400, seed: int = 0) -> tuple[list[list[float]], DataFrame]:
    """Medoids of the best of several seeded samples of bounded size, and all points with their nearest one (cluster_id from 1)."""
    rows = points.dropna(subset=list(dims))
    n = rows.count()
    best: tuple[float, list[list[float]]] | None = None
    for s in range(samples):
        share = min(1.0, 1.2 * size / max(n, 1))
        draw = F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(1_000_003)) / 1_000_003.0
        x = np.array([list(map(float, r)) for r in rows.where(draw < share).orderBy("id").select(*dims).collect()]).reshape(-1, len(dims))
        if not len(x):
            continue
        medoids = x[pam(x, k)[0]].tolist()
        cost = assign(rows, dims, medoids).agg(F.sum(F.sqrt("d2"))).first()[0]
        if best is None or cost < best[0]:
            best = (cost, medoids)
    medoids = best[1] if best else []
    if not medoids:
        return [], points.select("id", F.lit(0).alias("cluster_id"))
    own = assign(rows, dims, medoids).select("id", (F.col("centre") + 1).alias("cluster_id"))
    return medoids, own


def medoids(points: DataFrame, dims: Sequence[str], k: int, rounds: int = 20) -> tuple[list[list[float]], DataFrame]:
    """K medoids over all points, and the points with their nearest one (cluster_id from 1).

    Starts from the medoids of a sample. Each round all points go to their nearest medoid, and of each cluster's points
    the one nearest to its mean is the next medoid if that lowers the cluster's sum of distances over all its points.
    """
    rows = points.dropna(subset=list(dims))
    centres, _ = clara(rows, dims, k, samples=1)
    for _ in range(rounds if centres else 0):
        here = assign(rows, dims, centres)
        near = {r["centre"]: [r[f"m_{d}"] for d in dims] for r in here.groupBy("centre").agg(*[F.avg(d).alias(f"m_{d}") for d in dims]).collect()}  # one row per medoid
        to_mean = F.coalesce(*[F.when(F.col("centre") == c, sum(((F.col(d) - float(v)) * (F.col(d) - float(v)) for d, v in zip(dims, m)), F.lit(0.0))) for c, m in near.items()])
        best = {r["centre"]: list(r["p"]) for r in here.groupBy("centre").agg(F.min_by(F.struct(*dims), F.struct(to_mean, F.col("id"))).alias("p")).collect()}
        other = F.coalesce(*[F.when(F.col("centre") == c, F.sqrt(sum(((F.col(d) - float(v)) * (F.col(d) - float(v)) for d, v in zip(dims, p)), F.lit(0.0)))) for c, p in best.items()])
        better = {r["centre"] for r in here.groupBy("centre").agg(F.sum(F.sqrt("d2")).alias("old"), F.sum(other).alias("new")).where("new < old - 1e-12").collect()}
        if not better:
            break
        centres = [[float(v) for v in best[i]] if i in better else c for i, c in enumerate(centres)]
    if not centres:
        return [], points.select("id", F.lit(0).alias("cluster_id"))
    own = assign(rows, dims, centres).select("id", (F.col("centre") + 1).alias("cluster_id"))
    return centres, points.select("id").join(own, "id", "left").select("id", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"))


def silhouette(points: DataFrame, dims: Sequence[str], centres: Sequence[Sequence[float]]) -> float:
    """Mean over all points of how much nearer their medoid is than the next one, from 0 to 1."""
    each = F.array_sort(F.array(*[F.sqrt(sum(((F.col(d) - float(v)) * (F.col(d) - float(v)) for d, v in zip(dims, c)), F.lit(0.0))) for c in centres]))
    own, other = F.get(each, F.lit(0)), F.get(each, F.lit(1))
    return float(points.dropna(subset=list(dims)).agg(F.avg(F.when(other > 0, (other - own) / other).otherwise(0.0))).first()[0] or 0.0)


def best_medoids(points: DataFrame, dims: Sequence[str], most: int) -> tuple[list[list[float]], DataFrame]:
    """Medoids over all points for the number of clusters, from 2 to ``most``, of the largest mean silhouette; ties to the smaller."""
    trials = [medoids(points, dims, k) for k in range(2, max(most, 2) + 1)]
    scores = [silhouette(points, dims, c) if len(c) > 1 else 0.0 for c, _ in trials]
    return trials[int(np.argmax(scores))]


def knee_window(df: DataFrame) -> DataFrame:
    """Steps between neighbouring sorted distances of each k."""
    return df.withColumn("step", F.col("dist") - F.lead("dist").over(Window.partitionBy("k").orderBy(F.desc("dist"), "id")))
