"""Comparing and editing partitions of bursts into clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(one: DataFrame, other: DataFrame, key: str = "instance", cluster: str = "cluster_id") -> DataFrame:
    """Rows shared by each pair of clusters of two partitions; joined by key, never by position."""
    a = one.select(key, F.col(cluster).alias("c1"))
    b = other.select(key, F.col(cluster).alias("c2"))
    return a.join(b, key).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("shared"))


def mirkin(one: DataFrame, other: DataFrame, key: str = "instance", cluster: str = "cluster_id", noise: int | None = None) -> DataFrame:
    """(sum |C|^2 + sum |C'|^2 - 2 sum |C and C'|^2) / n^2, n from the first; without clusters ``noise`` if that is given."""
    keep: Column = F.lit(True) if noise is None else F.col(cluster) != noise
    one, other = one.where(keep), other.where(keep)
    counted = [df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n")) for df in (one, other)]
    shared = contingency(one, other, key, cluster).agg(F.sum(F.col("shared") * F.col("shared"))).scalar()
    square = F.sum(F.col("_n") * F.col("_n"))
    second = counted[1].agg(square).scalar()
    return counted[0].agg(((square + F.coalesce(second, F.lit(0)) - 2 * F.coalesce(shared, F.lit(0))) / (F.sum("_n") * F.sum("_n"))).alias("distance"))


def merge_ids(partition: DataFrame, ids: list[int], to: int, cluster: str = "cluster_id") -> DataFrame:
    """C14: a set of clusters becomes one."""
    return partition.withColumn(cluster, F.when(F.col(cluster).isin(*ids), F.lit(to)).otherwise(F.col(cluster)))
