"""Row numbers and neighbouring rows within keys that don't gather a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.skew import range_split
from quillon.runtime import cut


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_rank") -> DataFrame:
    """Rows with their number (from 1) within ``keys`` by ``order``; ties in any order.

    Rows are range-partitioned by (keys, order) and written once; each partition numbers its own rows of a
    key, and the counts of the partitions before it are added. The counts are one row per partition and key
    it touches, so only keys cut by a partition bound have more than one.
    """
    split = range_split(df, keys, order).withColumn("_part", F.spark_partition_id())
    split = cut(split, "ranked")
    counts = split.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = split.withColumn("_local", F.row_number().over(local))
    base = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], "_before")
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_part"])]
    joined = numbered.join(base, match, "inner")
    return joined.select(*df.columns, (F.col("_local") + F.col("_before")).alias(name))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with ``_next`` and ``_prev``: ``columns`` of the rows after and before them within ``keys``, null at the ends.

    As ``ranked``: partitions over (keys, order) look at their own rows, and the first and last row of each
    partition and key are handed to the partitions beside it.
    """
    split = cut(range_split(df, keys, order).withColumn("_part", F.spark_partition_id()), "neighbours")
    own, by = F.struct(*columns), F.struct(*order)
    ends = split.groupBy(*keys, "_part").agg(F.min_by(own, by).alias("_first"), F.max_by(own, by).alias("_last"))
    parts = Window.partitionBy(*keys).orderBy("_part")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], F.lead("_first").over(parts).alias("_after"), F.lag("_last").over(parts).alias("_before"))
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    seen = split.withColumn("_n", F.lead(own).over(local)).withColumn("_p", F.lag(own).over(local))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_part"])]
    return seen.join(ends, match).select(*df.columns, F.coalesce("_n", "_after").alias("_next"), F.coalesce("_p", "_before").alias("_prev"))
