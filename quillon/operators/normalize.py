"""Normalisation and sampling of burst metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.metrics import log_metric
from quillon.operators.ranks import ranked
from quillon.runtime import one_row


def range_normalize(df: DataFrame, columns: Sequence[str], factor: float = 1.0, complete: str = "burst_type = 0", log: bool = False) -> DataFrame:
    """Factor * (v - min) / (max - min) as n_<column> over complete bursts; others get null.

    A constant column gives 0; if every column is constant, so does each.
    """
    value = {c: F.when(F.expr(complete), log_metric(F.col(c)) if log else F.col(c).cast("double")) for c in columns}
    bounds = one_row(df, **{f"{k}_{c}": f(v) for c, v in value.items() for k, f in (("low", F.min), ("high", F.max))})
    out = df
    for c, v in value.items():
        low, width = bounds[f"low_{c}"], bounds[f"high_{c}"] - bounds[f"low_{c}"]
        out = out.withColumn(f"n_{c}", F.when(v.isNotNull(), F.when(width == 0, 0.0).otherwise(factor * (v - low) / width)))
    return out


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(v - mean) / sample standard deviation as z_<column>; null where that is 0 or undefined."""
    moments = one_row(df, **{f"{k}_{c}": f(c) for c in columns for k, f in (("mean", F.avg), ("sd", F.stddev_samp))})
    return df.select("*", *[F.when(moments[f"sd_{c}"] > 0, (F.col(c) - moments[f"mean_{c}"]) / moments[f"sd_{c}"]).alias(f"z_{c}") for c in columns])


def mean_adjust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """V - mean as a_<column>."""
    means = one_row(df, **{c: F.avg(c) for c in columns})
    return df.select("*", *[(F.col(c) - means[c]).alias(f"a_{c}") for c in columns])


def stride_sample(df: DataFrame, most: int, task: str = "task_id", order: str = "instance", seed: int = 0) -> DataFrame:
    """At most about ``most`` rows: per task floor(rows * most / all) strides, one row of each, by a seeded hash.

    If there are no more rows than ``most``, all are kept. A task too small for one stride gives none. The
    numbering within tasks is a range-partitioned rank: a window per task would put a heavy task into one.
    """
    total = df.count()
    if total <= most:
        return df
    sizes = df.groupBy(task).agg(F.count(F.lit(1)).alias("_size")).withColumn("_k", F.floor(F.col("_size") * most / total)).where("_k > 0")
    rows = ranked(df, [task], [order]).join(sizes, task)
    stride = F.floor((F.col("_rank") - 1) / F.floor(F.col("_size") / F.col("_k")))
    bucket = Window.partitionBy(task, "_stride").orderBy(F.xxhash64(F.lit(seed), order), order)
    picked = rows.withColumn("_stride", stride).where(F.col("_stride") < F.col("_k")).withColumn("_rn", F.row_number().over(bucket)).where("_rn = 1")
    return picked.select(*df.columns)
