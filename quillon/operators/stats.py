"""Aggregates over clustered bursts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import NOISE


def cluster_stats(bursts: DataFrame, cluster: str = "cluster_id", duration: str = "duration", metrics: Sequence[str] = ()) -> DataFrame:
    """A2-A4: per cluster its rows, total and mean duration, variance, share of all time, and means of sparse metrics."""
    stats = bursts.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("density"), F.sum(duration).alias("total_duration"), F.avg(duration).alias("avg_duration"),
        F.var_samp(duration).alias("var_duration"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])
    return stats.withColumn("share", F.col("total_duration") / bursts.agg(F.sum(duration)).scalar())


def rank_clusters(stats: DataFrame, cluster: str = "cluster_id", duration: str = "total_duration", noise: int = NOISE) -> DataFrame:
    """Clusters numbered from 1 by total duration, ties by id; noise stays 0. One row per cluster is sorted."""
    real = stats.where(F.col(cluster) != noise).withColumn("ranked_id", F.row_number().over(Window.orderBy(F.desc(duration), cluster)))
    return real.unionByName(stats.where(F.col(cluster) == noise).withColumn("ranked_id", F.lit(0)))


def extremes(bursts: DataFrame, columns: Sequence[str], key: str = "instance") -> DataFrame:
    """The instance of the least and the largest value of each column; ties to the smaller instance."""
    parts = []
    for c in columns:
        some = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col(key).alias("i")))
        most = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), (-F.col(key)).alias("i")))
        parts += [F.min(some).alias(f"min_{c}"), F.max(most).alias(f"max_{c}")]
    one = bursts.agg(*parts)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"min_{c}.v").cast("double").alias("least"), F.col(f"min_{c}.i").alias("least_instance"),
                 F.col(f"max_{c}.v").cast("double").alias("largest"), (-F.col(f"max_{c}.i")).alias("largest_instance")) for c in columns])))


def duration_histogram(bursts: DataFrame, duration: str = "duration") -> DataFrame:
    """Bursts and share of time by half-decade of the duration in microseconds."""
    some = bursts.where(F.col(duration) > 0).withColumn("bucket", F.floor(2 * F.log10(F.col(duration) / 1000)).cast("int"))
    counted = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("bursts"), F.sum(duration).alias("time"))
    return counted.select("bucket", "bursts", "time", (F.col("time") / some.agg(F.sum(duration)).scalar()).alias("share"))


def total_rollup(bursts: DataFrame, cluster: str, duration: str = "duration") -> DataFrame:
    """Rows and time per cluster with a total row (label GLOBAL)."""
    rolled = bursts.rollup(cluster).agg(F.grouping(cluster).alias("_g"), F.count(F.lit(1)).alias("occurrences"), F.sum(duration).alias("time"))
    return rolled.select(F.when(F.col("_g") == 1, "GLOBAL").otherwise(F.coalesce(F.col(cluster).cast("string"), F.lit("none"))).alias("cluster"), "occurrences", "time")


def transposed(stats: DataFrame, cluster: str, rows: Sequence[str], clusters: Sequence[int], noise: int = NOISE) -> DataFrame:
    """K2: statistics as rows, noise and clusters as columns; ``clusters`` are the columns' ids (of ranked clusters)."""
    long = stats.select(cluster, F.inline(F.array(*[F.struct(F.lit(r).alias("statistic"), F.col(r).cast("double").alias("v")) for r in rows])))
    wide = long.groupBy("statistic").pivot(cluster, list(clusters)).agg(F.first("v", ignorenulls=True))
    return wide.select("statistic", *[F.col(str(c)).alias("NOISE" if c == noise else f"Cluster {c}") for c in clusters])


def long_form(stats: DataFrame, cluster: str, rows: Sequence[str], noise: int = NOISE) -> DataFrame:
    """K2 without a bound on its columns: (statistic, cluster, v) for every cluster of ``stats``."""
    name = F.when(F.col(cluster) == noise, "NOISE").otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    return stats.select(name.alias("cluster"), F.inline(F.array(*[F.struct(F.lit(r).alias("statistic"), F.col(r).cast("double").alias("v")) for r in rows]))).select("statistic", "cluster", "v")


def run_averages(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], whole: Sequence[str] = ()) -> DataFrame:
    """Means over the backends of each run; those of ``whole`` (numbers of points and hulls) without their fraction."""
    means = [F.avg(m).cast("long").alias(m) if m in whole else F.avg(m).alias(m) for m in metrics]
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("backends"), *means)
