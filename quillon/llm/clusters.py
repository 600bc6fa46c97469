"""Clusters of similar bursts (problem 3).

A burst is a point of three logarithms: duration and the two counters. Bursts in one fine cell (STEP wide) are
copies of one record and are folded first. A record has a set of tokens for each of its three values: the coarse
interval it falls into in each of SHIFTS grids, shifted by one fine cell each, so that the Jaccard similarity of two
records' sets falls with the distance of their values, from 1 to 0 at SHIFTS fine cells. Records are alike if the
similarity of each of the three sets reaches JACCARD. MinHash bands of one hash per set give candidate pairs, exact
Jaccard verifies them, and connected components of the pairs are clusters. Loose ones are split around the records
with most neighbours.

A band's bucket lies within one coarse cell and so holds at most SHIFTS^3 records; pairs are compared by shifted rows
of sorted buckets, some buckets at a time, and a task passes on stars instead of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.components import components, smallest
from quillon.operators.ranks import ranked
from quillon.runtime import cut, dim_join

DIMS = ("x", "y", "z")
STEP = 0.1  #: width of the fine cells, in natural logarithms
SHIFTS = 8  #: grids of each value, of intervals SHIFTS * STEP wide
BANDS = 20  #: a pair just similar enough shares a bucket of one band with a chance of 0.6^3, of any with 0.992
JACCARD = 0.5  #: reached at two fine cells apart (6/10), not at three (5/11): no link reaches over ln(1.8 / 1.3)
PIECE = 100_000  #: rows of buckets compared at a time
NEAR, FAR, LEAST = 1.3, 1.8, 20
TYPICAL = 3
COARSE = 7  #: fine cells in a coarse cell of the isolation check; at least ln(FAR) / STEP + 1
BITS = 9  #: of one cell number: ln(2^63) / STEP is below 2^9


def points(bursts: DataFrame, events: DataFrame, counters: tuple[int, int] = (42000050, 42000059)) -> DataFrame:
    """instance, trace_id, v0..v2 (duration and counters), x, y, z (logarithms) of each burst with all three above 0."""
    own = bursts.where(F.col("instance").isNotNull() & F.col("trace_id").isNotNull()).groupBy("instance").agg(F.max("trace_id").alias("trace_id"), F.max("duration").alias("v0"))
    e = events.where(F.col("event_type").isin(*counters) & (F.col("event_value") > 0)).groupBy("instance").agg(
        *[F.max(F.when(F.col("event_type") == t, F.col("event_value"))).alias(f"v{k}") for k, t in enumerate(counters, 1)])
    rows = own.where("v0 > 0").join(e.where("v1 > 0 and v2 > 0"), "instance")
    return rows.select("*", *[F.log(F.col(f"v{k}").cast("double")).alias(d) for k, d in enumerate(DIMS)])


def with_cells(rows: DataFrame) -> DataFrame:
    """The rows with ``cell``: the number of the trace and the three numbers of the fine cell in one. Trace ids that don't fit are numbered first."""
    ends = rows.agg(F.min("trace_id"), F.max("trace_id")).first()
    number = F.col("trace_id")
    if ends[0] is not None and (ends[0] < 0 or ends[1] >= 1 << (63 - 3 * BITS)):
        names = ranked(rows.select("trace_id").distinct(), [], ["trace_id"], "_number")
        rows, number = dim_join(rows, names, ["trace_id"]), F.col("_number")
    for d in DIMS:
        number = F.shiftleft(number, BITS).bitwiseOR(F.floor(F.col(d) / STEP).cast("long"))
    return rows.withColumn("cell", number).drop("_number")


def unpack_cells(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trace and the three cell numbers."""
    part = (1 << BITS) - 1
    return cell >> (3 * BITS), np.stack([(cell >> (BITS * k)) & part for k in (2, 1, 0)], 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(place: np.ndarray) -> np.ndarray:
    """(records, 3, SHIFTS): for each value and shifted grid the interval it falls into."""
    return ((place[:, :, None] + np.arange(SHIFTS)) // SHIFTS).astype(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least Jaccard similarity of the three sets of pairs of records."""
    common = (a == b).sum(2)
    return (common / (2 * SHIFTS - common)).min(1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grid = np.arange(3 * SHIFTS, dtype=np.uint64).reshape(3, SHIFTS) << np.uint64(32)
    for batch in batches:
        cell = batch.column(0).to_numpy()
        trace, place = unpack_cells(cell)
        tokens = token_sets(place).astype(np.uint64) | grid
        own = _mix(trace.astype(np.uint64) * np.uint64(2654435761))
        for band in range(BANDS):
            hashes = _mix(tokens + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % 2**64))
            least = np.take_along_axis(tokens, hashes.argmin(2)[:, :, None], 2)[:, :, 0]
            bucket = own + np.uint64(band)
            for k in range(3):
                bucket = _mix(bucket ^ _mix(least[:, k]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(cell)], ["bucket", "cell"])


def _stars(bucket: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each record of some whole buckets with the least one it is joined to by verified pairs."""
    cells, at = np.unique(cell, return_inverse=True)
    trace, place = unpack_cells(cells)
    tokens = token_sets(place)
    new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[new, len(bucket)])
    left = np.repeat(size, size) - (np.arange(len(bucket)) - np.repeat(new, size))  # rows from here to the bucket's end
    node = root = np.zeros(0, np.int64)
    rows = np.arange(len(bucket))
    for d in range(1, int(size.max(initial=1))):
        rows = rows[left[rows] > d]
        a, b = at[rows], at[rows + d]
        alike = (similarity(tokens[a], tokens[b]) >= JACCARD) & (trace[a] == trace[b])
        node, root = smallest(np.r_[node, a[alike]], np.r_[root, b[alike]])
        node, root = node[node != root], root[node != root]
    return cells[node], cells[root]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the verified pairs of a partition's buckets, some buckets at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(i).to_numpy() for i in (0, 1)]))
        if sum(h.shape[1] for h in held) >= PIECE:
            whole = np.concatenate(held, 1)
            end = int(np.searchsorted(whole[0], whole[0, -1]))  # the last bucket may go on
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*whole[:, :end])], ["a", "b"])
            held = [whole[:, end:]]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*np.concatenate(held, 1))], ["a", "b"])


def _split(t: pa.Table) -> pa.Table:
    """Parts of one loose component around the records with most neighbours; at most as many rows as a trace has fine cells.

    Neighbours are looked up by their cell numbers, so the work grows with the cells and not with their square.
    """
    cell, rows = t.column("cell").to_numpy(), t.column("rows").to_numpy()
    order = np.argsort(cell)
    cell, rows = cell[order], rows[order]
    _, place = unpack_cells(cell)
    reach = int(np.log(NEAR) / STEP)
    steps = np.array(list(product(range(-reach, reach + 1), repeat=3)))
    shift = (steps[:, 0] << (2 * BITS)) + (steps[:, 1] << BITS) + steps[:, 2]

    def around(i: np.ndarray, step: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that lie by a step from rows ``i``, where there is one."""
        to = np.minimum(np.searchsorted(cell, cell[i] + by), len(cell) - 1)
        return to, (cell[to] == cell[i] + by) & (place[to] == place[i] + step).all(-1)

    degree, every = np.zeros(len(cell), np.int64), np.arange(len(cell))
    for step, by in zip(steps, shift.tolist()):
        to, there = around(every, step, np.int64(by))
        degree[there] += rows[to[there]]
    part = np.full(len(cell), -1)
    for i in np.lexsort((cell, -degree)).tolist():
        if part[i] < 0:
            to, there = around(np.full(len(steps), i), steps, shift)
            to = to[there]
            part[to[part[to] < 0]] = i
    return pa.table({"cell": pa.array(cell), "cluster": pa.array(cell[part])})


def clusters(bursts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, clusters, isolated clusters).

    members: instance, trace_id, v0..v2, x, y, z, cell, cluster - each burst with all three values above 0.
    clusters: cluster, trace_id, size, first (least instance), m0..m2 (medians), l0..l2 and h0..h2 (ranges).
    isolated: those of at least LEAST bursts within a factor NEAR of the medians, with every other burst of
    the trace beyond FAR in some value. Bursts and event rows count once; nulls and values of 0 or less leave a
    burst out. Empty tables give empty results.
    """
    rows = with_cells(cut(points(bursts, events), "points"))
    cells = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), *[f(d).alias(n + d) for d in DIMS for n, f in (("lo_", F.min), ("hi_", F.max))]), "cells")
    banded = cells.select("cell").mapInArrow(_bands, "bucket long, cell long")
    stars = banded.repartition("bucket").sortWithinPartitions("bucket", "cell").mapInArrow(_verified, "a long, b long")
    roots = components(stars)
    joined = cells.join(roots.select(F.col("node").alias("cell"), "root"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    spread = joined.groupBy("root").agg(*[(F.max("hi_" + d) - F.min("lo_" + d)).alias("w_" + d) for d in DIMS])
    loose = spread.where(F.greatest(*["w_" + d for d in DIMS]) > 2 * np.log(NEAR)).select("root", F.lit(True).alias("loose"))
    marked = cut(joined.join(loose, "root", "left"), "components")
    parts = marked.where("loose").select("root", "cell", "rows").groupBy("root").applyInArrow(_split, "cell long, cluster long")
    places = cut(marked.where("loose is null").select("cell", F.col("root").alias("cluster")).unionByName(parts), "places")
    members = cut(dim_join(rows, places, ["cell"]), "members")
    stats = cut(members.groupBy("cluster").agg(
        F.max("trace_id").alias("trace_id"), F.count(F.lit(1)).alias("size"), F.min("instance").alias("first"),
        *[F.percentile_approx(f"v{k}", F.lit(0.5), F.lit(10000)).alias(f"m{k}") for k in range(3)],
        *[F.min(f"v{k}").alias(f"l{k}") for k in range(3)], *[F.max(f"v{k}").alias(f"h{k}") for k in range(3)]), "clusters")
    tight = stats.where("size >= %d" % LEAST)
    for k in range(3):
        tight = tight.where((F.col(f"h{k}") <= F.col(f"m{k}") * NEAR) & (F.col(f"m{k}") <= F.col(f"l{k}") * NEAR))
    return members, stats, tight.join(_invaded(tight, cells, places, members), "cluster", "left_anti")


def _invaded(tight: DataFrame, cells: DataFrame, places: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with a burst of another cluster within FAR of all medians.

    Cells meet clusters by coarse cell: a cluster looks into its own and the neighbouring ones. Only bursts of
    cells that reach into a cluster's box are compared one by one.
    """
    number = lambda c, k: F.shiftright(c, BITS * (2 - k)).bitwiseAND((1 << BITS) - 1)
    look = tight.select("cluster", F.shiftright("cluster", 3 * BITS).alias("_trace"), *[F.col(f"m{k}").cast("double").alias(f"m{k}") for k in range(3)])
    for k in range(3):
        at = F.floor(F.floor(F.log(f"m{k}") / STEP) / COARSE).cast("long")
        look = look.withColumn(f"c{k}", F.explode(F.array(at - 1, at, at + 1)))
    own = cells.join(places, "cell").withColumnRenamed("cluster", "other").withColumn("_trace", F.shiftright("cell", 3 * BITS))
    for k in range(3):
        own = own.withColumn(f"c{k}", F.floor(number(F.col("cell"), k) / COARSE).cast("long"))
    reach = float(np.log(FAR)) + 1e-9
    meets = F.col("other") != F.col("cluster")
    for k, d in enumerate(DIMS):
        meets &= (F.col("lo_" + d) <= F.log(f"m{k}") + reach) & (F.col("hi_" + d) >= F.log(f"m{k}") - reach)
    doubt = look.join(own, ["_trace", "c0", "c1", "c2"]).where(meets).select("cell", "cluster", "m0", "m1", "m2")
    close = F.lit(True)
    for k in range(3):
        close &= (F.col(f"v{k}") <= F.col(f"m{k}") * FAR) & (F.col(f"m{k}") <= F.col(f"v{k}") * FAR)
    return dim_join(members.select("cell", "v0", "v1", "v2"), cut(doubt, "doubt"), ["cell"]).where(close).select("cluster").distinct()


def typical(members: DataFrame, stats: DataFrame) -> DataFrame:
    """The TYPICAL instances nearest to the medians of each cluster, with their rank; ties by instance."""
    near = dim_join(members, stats.select("cluster", "size", "first", "m0", "m1", "m2"), ["cluster"])
    apart = F.greatest(*[F.abs(F.col(d) - F.log(F.col(f"m{k}").cast("double"))) for k, d in enumerate(DIMS)])
    ranked = near.withColumn("apart", apart).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("apart", "instance")))
    return ranked.where(F.col("rank") <= TYPICAL).select("trace_id", F.col("first").alias("group_first"), "size", "rank", "instance", "m0", "m1", "m2")
