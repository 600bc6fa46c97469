"""Per-key results where a few keys hold most rows (problem 1).

Rows are range-partitioned on the composite (key, secondary order). The range bounds are quantiles of a
sample, taken by Spark's range partitioner, so a heavy key fills several whole partitions and shares only
its outermost ones with other keys. Each partition folds its rows of a key into one partial state; the
states of a key - one per partition it touches - are stitched afterwards. No task ever sees more than its
share of rows, whatever the key distribution is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, most: int | None = None) -> DataFrame:
    """Range partitions over (keys, order), sorted inside; heavy keys are split at sampled quantiles.

    Their number is the session's, and AQE joins small ones; where that leaves more than ``most`` of ``rows`` in one, more are made.
    """
    by = [*keys, *order]
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows and most and rows > most * usual:
        return df.repartitionByRange(-(-rows // most), *by).sortWithinPartitions(*by)
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def skewed_stats(df: DataFrame, key: str, order: Sequence[str], states: dict[str, Column]) -> DataFrame:
    """Aggregates per key: partial states per range partition, merged by key.

    ``states`` are aggregate columns. Catalyst folds them partially inside each range partition, so the
    exchange by key carries one row per (partition, key) pair, at most keys + partitions rows.
    Null keys form one group of their own. Null measurements are skipped by sums and means; a key without
    any gives a null sum and mean. An empty table gives no rows. Columns not named are never read.
    """
    ranged = df.repartitionByRange(F.col(key), *[F.col(c) for c in order])
    return ranged.groupBy(key).agg(*[c.alias(n) for n, c in states.items()])


def heavy_keys(stats: DataFrame, key: str, count: str, share: float) -> DataFrame:
    """Non-null keys that hold at least ``share`` of the rows with a non-null key."""
    known = stats.where(F.col(key).isNotNull()).select(key, count)
    total = known.agg(F.sum(count).alias("_all"))
    # whole numbers, so that a key exactly at the share is kept
    return known.where(F.col(count) * 10**6 >= total.scalar() * round(share * 10**6)).select(key)


def ordered_stats(df: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """Order-dependent results per key: rows, first and last order value, largest step between neighbours.

    Each range partition gives one state (rows, first, last, largest inner step) per key it touches; a
    key's states are stitched in partition order, where the step across a boundary is the next first minus
    the last before. Rows with a null key or order are left out; ties of the order give a step of 0.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.col(tie).cast("long").alias("t"))
    states = range_split(rows, ["k"], ["o", "t"]).mapInArrow(_fold_steps, "k long, n long, first long, last long, step long")
    merged = states.groupBy("k").agg(
        F.sum("n").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("step").alias("step"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("parts"),
    )
    across = F.expr("aggregate(zip_with(slice(parts, 2, size(parts)), slice(parts, 1, size(parts) - 1), (b, a) -> b.first - a.last), 0L, (m, x) -> greatest(m, x))")
    step = F.when(F.col("rows") > 1, F.greatest("step", F.when(F.size("parts") > 1, across)))
    return merged.select(F.col("k").alias(key), "rows", "first", "last", step.alias("largest_step"))


def _fold_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the key that is still open: (key, rows, first, last, step or None)
    done: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, o = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.r_[0, np.flatnonzero(np.diff(k)) + 1]
        ends = np.r_[cuts[1:], len(k)]
        diff = np.diff(o)
        for s, e in zip(cuts.tolist(), ends.tolist()):
            step = int(diff[s:e - 1].max()) if e - s > 1 else None
            if held and held[0] == k[s]:
                step = max(x for x in (held[4], step, int(o[s]) - held[3]) if x is not None)
                held = (held[0], held[1] + e - s, held[2], int(o[e - 1]), step)
            else:
                done += [held] if held else []
                held = (int(k[s]), e - s, int(o[s]), int(o[e - 1]), step)
    done += [held] if held else []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*done)], ["k", "n", "first", "last", "step"])
