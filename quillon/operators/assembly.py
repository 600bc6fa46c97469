"""Assembling bursts: which state, region or semantic interval an event belongs to, and its counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import COUNTER_SET_TYPE, RUNNING
from quillon.operators.ranks import neighbours
from quillon.operators.skew import range_split
from quillon.runtime import cut


def as_of(events: DataFrame, states: DataFrame, keys: Sequence[str], ts: str = "ts", begin: str = "begin", payload: Sequence[str] = ("begin", "end"), tie: str | None = None) -> DataFrame:
    """Each event with the latest state that began before it (``payload`` columns, null if none); an event at a begin belongs to the state before.

    Events and states are united and range-partitioned by (keys, time); a partition fills its own events
    forward, and the last state of the partitions before it is carried over for keys that go on. So a key with
    a third of all rows is still spread over many tasks.
    """
    state = F.struct(*[F.col(c) for c in payload])
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    columns = [c for c in events.columns if c not in keys and c != ts]
    left = events.select(*keys, F.col(ts).alias("_t"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), F.struct(*columns).alias("_event") if columns else F.lit(True).alias("_event"))
    right = states.select(*keys, F.col(begin).alias("_t"), F.lit(1).alias("_kind"), order.alias("_tie"), state.alias("_state"))
    both = left.unionByName(right, allowMissingColumns=True)
    split = cut(range_split(both, keys, ["_t", "_kind", "_tie"]).withColumn("_part", F.spark_partition_id()), "asof")
    local = Window.partitionBy(*keys, "_part").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = split.withColumn("_own", F.last("_state", ignorenulls=True).over(local)).where("_kind = 0")
    ends = split.groupBy(*keys, "_part").agg(F.max_by("_state", F.when(F.col("_kind") == 1, F.struct("_t", "_tie"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_before is not null")
    carried = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], "_before")
    match = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate([*keys, "_part"])]
    joined = filled.join(carried, match, "left").withColumn("_found", F.coalesce("_own", "_before"))
    own = [F.col(f"_event.{c}").alias(c) for c in columns]
    return joined.select(*keys, F.col("_t").alias(ts), *own, *[F.col(f"_found.{c}").alias(c) for c in payload])


def burst_events(events: DataFrame, states: DataFrame, keys: Sequence[str] = ("task", "thread"), running: int | None = RUNNING, tie: str | None = "line") -> DataFrame:
    """Events inside intervals, begin < ts <= end, each with its interval's begin, end and line.

    ``states`` have begin, end, line and, if ``running`` is given, state. A shared boundary belongs to the
    earlier interval. Events in gaps are left out. J7, the flush at the end of input, needs nothing in batch.
    """
    busy = states if running is None else states.where(F.col("state") == running)
    found = as_of(events, busy.withColumnRenamed("line", "burst_line"), keys, payload=("begin", "end", "burst_line"), tie="burst_line" if tie else None)
    return found.where(F.col("ts") <= F.col("end"))


def sums(inside: DataFrame, keys: Sequence[str] = ("task", "thread")) -> DataFrame:
    """A1: the sum of each event type per burst."""
    return inside.groupBy(*keys, "begin", "end", "burst_line", "event_type").agg(F.sum("event_value").alias("total"))


def cut_counter_sets(inside: DataFrame, keys: Sequence[str] = ("task", "thread"), order: Sequence[str] = ("line", "ordinal")) -> DataFrame:
    """At a burst's end, pairs from a counter-set change on, in its record or a later one, aren't credited to it."""
    burst, place = Window.partitionBy(*keys, "begin"), F.struct(*order)
    change = F.when((F.col("event_type") == COUNTER_SET_TYPE) & (F.col("ts") == F.col("end")), place)
    marked = inside.withColumn("_change", F.min(change).over(burst))
    return marked.where(F.col("_change").isNull() | (F.col("ts") != F.col("end")) | (place < F.col("_change"))).drop("_change")


def consecutive_regions(events: DataFrame, types: Sequence[int], keys: Sequence[str] = ("task", "thread"), order: Sequence[str] = ("ts", "line")) -> DataFrame:
    """Each listed event closes the region before it and opens the next; the last one stays open and gives none."""
    nxt = neighbours(events.where(F.col("event_type").isin(*types)), keys, order, ["ts"]).withColumn("end", F.col("_next.ts"))
    return nxt.where("end is not null").select(*keys, F.col("ts").alias("begin"), "end", F.col("event_type").alias("region_type"), F.col("event_value").alias("region_value"), "line")


def event_regions(events: DataFrame, types: Sequence[int], keys: Sequence[str] = ("task", "thread"), order: Sequence[str] = ("ts", "line")) -> tuple[DataFrame, DataFrame]:
    """Regions from a listed event with a value to its closing 0, and the opens or closes that have no partner."""
    listed = events.where(F.col("event_type").isin(*types)).withColumn("_open", F.col("event_value") != 0)
    seen = neighbours(listed, keys, order, ["_open", "ts"]).select("*", F.col("_next._open").alias("_next_open"), F.col("_next.ts").alias("end"), F.col("_prev._open").alias("_prev_open"))
    good = seen.where(F.col("_open") & ~F.col("_next_open"))
    bad = seen.where((F.col("_open") & F.coalesce("_next_open", F.lit(True))) | (~F.col("_open") & ~F.coalesce("_prev_open", F.lit(False))))
    regions = good.select(*keys, F.col("ts").alias("begin"), "end", F.col("event_type").alias("region_type"), F.col("event_value").alias("region_value"), "line")
    return regions, bad.select(*events.columns)


def without_late_types(inside: DataFrame, keys: Sequence[str] = ("task", "thread")) -> DataFrame:
    """After a counter-set change inside a region, types not seen before it are no counters of the region."""
    burst = Window.partitionBy(*keys, "begin")
    own = Window.partitionBy(*keys, "begin", "event_type")
    change = F.when((F.col("event_type") == COUNTER_SET_TYPE) & (F.col("ts") < F.col("end")), F.col("ts"))
    marked = inside.withColumn("_change", F.min(change).over(burst)).withColumn("_first", F.min("ts").over(own))
    return marked.where(F.col("_change").isNull() | (F.col("_first") <= F.col("_change"))).drop("_change", "_first")


def by_line(partition: DataFrame, rows: DataFrame, give: Sequence[str] = ("cluster_id",), keys: Sequence[str] = ("line",)) -> DataFrame:
    """``give`` of a partition to rows by the line of their record; a row without one gets null."""
    return rows.join(partition.select(*keys, *give), list(keys), "left")
