"""Frequent subsequences with gaps over many entities' sequences (problem 2).

Vertical identifier lists: an event is a list of (sequence, position) pairs, a pattern the list of the places
where it ends. A pattern grows by a temporal join of its list with the events 1 to MAX_GAP positions on, and
patterns below the support - the number of distinct sequences of their group that contain them - are pruned.

Rows lie in range partitions over (group, sequence, time), so that a long sequence or a heavy group fills many
partitions. A group inside one partition is mined there. Of a group that may go on elsewhere - the first and the last
one of a partition - a partition gives its rows and the pairs of events in them. Pairs are counted over all
partitions, and longer patterns grow, length by length, only from those that are frequent in the whole group. The first and the last
sequence of a partition may be cut: their patterns are given sequence by sequence, and the events at the cuts, from
which the patterns across cuts follow.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import range_split
from quillon.runtime import cut, dim_join

MAX_GAP, SHORTEST, LONGEST = 3, 3, 4
PARTITION_ROWS = 1_000_000  #: rows of a range partition, held as arrays
REACH = MAX_GAP * (LONGEST - 1)  #: positions from a pattern's first event to the last possible one


def mine(sequence: np.ndarray, item: np.ndarray, good: np.ndarray, group: np.ndarray, need: np.ndarray, support: bool, lengths: tuple[int, int] = (SHORTEST, LONGEST), parents: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]]:
    """Patterns by growing identifier lists over positions in (sequence, order) order.

    ``good`` marks events that may be in a pattern, ``group`` is the group of each sequence and ``need`` the
    least support of each group, below which patterns are pruned (0 prunes nothing). ``parents``, if given, are the
    frequent patterns one shorter than the first of ``lengths``: a pattern without its first or its last item must be
    one of them. Gives, for each of the ``lengths``, pattern numbers with groups and
    their supports (``support``), or with sequences, and the patterns by number.
    """
    kinds = np.unique(item[good])
    code = np.minimum(np.searchsorted(kinds, item), max(len(kinds) - 1, 0))
    u = max(1, len(kinds))
    pairs = allowed = None
    if parents is not None:
        parents = parents[np.isin(parents, kinds).all(1)]
        allowed = set(map(tuple, parents.tolist()))
        at = np.searchsorted(kinds, parents)
        pairs = np.unique(at[:, :-1] * u + at[:, 1:])
    n_seq, n_group = len(group), len(need)
    end = np.flatnonzero(good)
    pattern = code[end]
    names: list[tuple[int, ...]] = [(int(k),) for k in kinds]
    for length in range(2, lengths[1] + 1):
        ends, codes = [], []
        for gap in range(1, MAX_GAP + 1):
            to = end + gap
            ok = to < len(item)
            a, b = end[ok], to[ok]
            hit = (sequence[a] == sequence[b]) & good[b]
            if pairs is not None:
                hit &= np.isin(code[a] * u + code[b], pairs)
            ends.append(b[hit])
            codes.append(pattern[ok][hit].astype(np.int64) * u + code[b[hit]])
        end, grown = np.concatenate(ends), np.concatenate(codes)
        if not len(end):
            return
        both, pattern = np.unique(grown, return_inverse=True)
        names = [(*names[c // u], int(kinds[c % u])) for c in both.tolist()]
        if allowed is not None and lengths[0] - 1 <= length <= lengths[0]:
            fine = np.array([n in allowed if length < lengths[0] else n[1:] in allowed for n in names], bool)
            end, pattern = end[fine[pattern]], pattern[fine[pattern]]
            if not len(end):
                return
        p = len(both)
        # one entry per (place, pattern)
        keys = np.unique(end * p + pattern)
        end, pattern = keys // p, keys % p
        found = np.unique(pattern * n_seq + sequence[end])
        in_group, counts = np.unique((found // n_seq) * n_group + group[found % n_seq], return_counts=True)
        keep = counts >= need[in_group % n_group]
        if length >= lengths[0]:
            if support:
                yield in_group[keep] // n_group, np.stack([in_group[keep] % n_group, counts[keep]]), names
            else:
                yield found // n_seq, np.stack([found % n_seq, np.ones(len(found), np.int64)]), names
        alive = np.zeros(p * n_group, bool)
        alive[in_group[keep]] = True
        live = alive[pattern * n_group + group[sequence[end]]]
        end, pattern = end[live], pattern[live]


OUT = "kind string, piece long, trace_id long, task_id long, thread_id long, pattern string, support long, need long, time long, head array<long>, tail array<long>, blob binary"


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    names, arrays = [], []
    columns["kind"] = [kind] * n
    for part in OUT.split(", "):
        name, sort = part.split(" ")
        names.append(name)
        arrays.append(pa.array(columns[name], types[sort]) if name in columns else pa.nulls(n, types[sort]))
    return pa.RecordBatch.from_arrays(arrays, names)


def _label(names: list[tuple[int, ...]], numbers: np.ndarray) -> list[str]:
    text = {i: "-".join(map(str, names[i])) for i in np.unique(numbers).tolist()}
    return [text[i] for i in numbers.tolist()]


def _items_of(labels: list[str]) -> np.ndarray:
    return np.array([p.split("-") for p in labels], np.int64)


class Part:
    """What a partition holds of one group: its sequences one after the other; those at the partition's ends may be cut."""

    def __init__(self, trace: int, need: int, keys: np.ndarray, sequence: np.ndarray, item: np.ndarray, good: np.ndarray, cut_ends: tuple[bool, bool]) -> None:
        self.trace, self.need, self.keys, self.item, self.good, self.cut_ends = trace, need, keys, item, good, cut_ends
        self.sequence = sequence - sequence[0]

    def found(self, length: int, parents: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Supports of patterns in whole sequences, and the patterns of those that may be cut."""
        last = int(self.sequence[-1])
        edges = [s for s, at_end in zip((0, last), self.cut_ends) if at_end]
        edge = np.isin(self.sequence, edges)
        one, none = np.zeros(last + 1, np.int64), np.zeros(1, np.int64)
        for number, (_, support), names in mine(self.sequence, self.item, self.good & ~edge, one, none, True, (length, length), parents):
            n = len(number)
            yield _batch("whole", n, trace_id=np.full(n, self.trace), pattern=_label(names, number), support=support, need=np.full(n, self.need))
        if edge.any():
            for number, (where, _), names in mine(self.sequence[edge], self.item[edge], self.good[edge], one, none, False, (length, length), parents):
                n = len(number)
                yield _batch("cut", n, trace_id=np.full(n, self.trace), task_id=self.keys[0][where], thread_id=self.keys[1][where], pattern=_label(names, number), need=np.full(n, self.need))


def _mine_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    trace, task, thread, time, item = (t.column(c).to_numpy() for c in ("trace_id", "task_id", "thread_id", "begin_time", "cluster_id"))
    need = t.column("need").fill_null(-1).to_numpy()
    item, good = item.astype(np.int64), need >= 0
    new = np.r_[True, (trace[1:] != trace[:-1]) | (task[1:] != task[:-1]) | (thread[1:] != thread[:-1])]
    first = np.flatnonzero(new)
    sequence = np.cumsum(new) - 1
    tops, group = np.unique(trace[first], return_inverse=True)
    least = np.zeros(len(tops), np.int64)
    np.maximum.at(least, group[sequence], need)
    last_seq = len(first) - 1
    open_groups = sorted({int(group[0]), int(group[-1])})
    inner = ~np.isin(group[sequence], open_groups)
    for number, where, names in mine(sequence, item, good & inner, group, least, True):
        g, support = where
        yield _batch("closed", len(number), trace_id=tops[g], pattern=_label(names, number), support=support, need=least[g])
    for g in open_groups:
        own = np.flatnonzero(group[sequence] == g)
        s = np.unique(sequence[own])
        part = Part(int(tops[g]), int(least[g]), np.stack([task[first[s]], thread[first[s]]]), sequence[own], item[own], good[own], (0 in s, last_seq in s))
        yield _batch("rows", 1, piece=[(TaskContext.get().partitionId() << 1) + (g != open_groups[0])], trace_id=[part.trace], blob=[pickle.dumps(part)])
        yield from part.found(2, None)
    for s in {0, last_seq}:
        a, b = first[s], first[s + 1] if s < last_seq else len(item)
        signed = np.where(good[a:b], item[a:b], -1).tolist()  # other events only take up a place
        long = len(signed) > 2 * REACH
        yield _batch("edge", 1, trace_id=[trace[a]], task_id=[task[a]], thread_id=[thread[a]], time=[time[a]], need=[least[group[s]]],
                     head=[signed[:REACH] if long else signed], tail=[signed[-REACH:] if long else None])


CUT = "trace_id long, task_id long, thread_id long, pattern string, need long"


def _across(length: int):
    def run(t: pa.Table) -> pa.Table:
        """Patterns of one sequence that cross its cuts."""
        t = t.sort_by("time")
        line: list[int] = []
        for head, tail in zip(t.column("head").to_pylist(), t.column("tail").to_pylist()):
            line += head
            if tail is not None:  # what lies between cannot be reached over
                line += [-1] * (REACH + 1) + tail
        item = np.array(line, np.int64)
        parents = _items_of(t.column("parents")[0].as_py()) if "parents" in t.column_names else None
        found: list[str] = []
        for number, _, names in mine(np.zeros(len(item), np.int64), item, item >= 0, np.zeros(1, np.int64), np.zeros(1, np.int64), False, (length, length), parents):
            found += _label(names, number)
        n = len(found)
        same = lambda c: pa.array([t.column(c)[0].as_py()] * n, pa.int64())
        return pa.table({"trace_id": same("trace_id"), "task_id": same("task_id"), "thread_id": same("thread_id"), "pattern": pa.array(found, pa.string()), "need": same("need")})

    return run


def _grow(length: int):
    def run(rows: pa.Table, parents: pa.Table) -> pa.Table:
        """Patterns of one partition's part of a group, from the group's frequent ones one shorter."""
        out = [_batch("none", 0)]
        if rows.num_rows and parents.num_rows:
            out += pickle.loads(rows.column("blob")[0].as_py()).found(length, _items_of(parents.column("parents")[0].as_py()))
        return pa.Table.from_batches(out)

    return run


def _merged(whole: DataFrame, single: DataFrame, keys: list[str]) -> DataFrame:
    """Frequent patterns by support: counts of whole sequences, and cut sequences that have a pattern once."""
    once = single.groupBy(*keys, "pattern").agg(F.max("need").alias("need")).select("trace_id", "pattern", F.lit(1).cast("long").alias("support"), "need")
    merged = whole.select("trace_id", "pattern", "support", "need").unionByName(once).groupBy("trace_id", "pattern").agg(F.sum("support").alias("support"), F.max("need").alias("need"))
    return merged.where("support >= need").select("trace_id", "pattern", "support")


def frequent_subsequences(bursts: DataFrame, share: float = 0.6, least_id: int = 6) -> DataFrame:
    """trace_id, pattern (ids joined by -), support: patterns in at least ``share`` of a trace's sequences.

    A sequence is a (trace, task, thread) with its cluster ids of ``least_id`` and above by begin_time, ties
    by instance. Duplicates count once by instance. Rows with a null in instance, source, time or id are no
    events. An empty table gives no patterns; other columns are ignored. A group of one sequence gives all its
    patterns.
    """
    keys = ["trace_id", "task_id", "thread_id"]
    columns = [*keys, "begin_time", "cluster_id"]
    rows = bursts.select("instance", *columns).where(F.col("instance").isNotNull()).groupBy("instance").agg(*[F.max(c).alias(c) for c in columns])
    rows = rows.dropna().where(F.col("cluster_id") >= least_id)
    rows = cut(rows.select(*[F.col(c).cast("long") for c in ("instance", *columns)]), "sequences")
    # level 1: distinct sequences per id, all pre-aggregated before the exchange
    entity_ids = rows.groupBy(*keys, "cluster_id").agg(F.lit(1).alias("_one"))
    ids = entity_ids.groupBy("trace_id", "cluster_id").agg(F.count("_one").alias("_support"))
    total = rows.groupBy(*keys).agg(F.lit(1).alias("_one")).groupBy("trace_id").agg(F.count("_one").alias("_n"))
    need = F.ceil(F.col("_n") * F.lit(round(share * 10**6)) / 10**6)
    frequent = ids.join(total, "trace_id").where(F.col("_support") * 10**6 >= F.col("_n") * round(share * 10**6))
    frequent = cut(frequent.select("trace_id", "cluster_id", need.cast("long").alias("need")), "frequent")
    marked = dim_join(rows, frequent, ["trace_id", "cluster_id"], "left")
    ranged = range_split(marked.select("instance", *columns, "need"), keys, ["begin_time", "instance"], rows.count(), PARTITION_ROWS)
    mined = cut(ranged.mapInArrow(_mine_partition, OUT), "mined")
    cut_of = lambda df: df.where("kind = 'cut'").select(*keys, "pattern", "need")
    edges = mined.where("kind = 'edge'").select(*keys, "time", "head", "tail", "need")
    found, across = mined, edges.groupBy(*keys).applyInArrow(_across(2), CUT)
    pieces = mined.where("kind = 'rows'")
    result = mined.where("kind = 'closed'").select("trace_id", "pattern", "support")
    for length in range(2, LONGEST + 1):
        if length > 2:
            allowed = pieces.select(F.col("piece").alias("of"), "trace_id").join(parents, "trace_id").select("of", "parents")
            found = cut(pieces.select("piece", "blob").groupBy("piece").cogroup(allowed.groupBy("of")).applyInArrow(_grow(length), OUT), "grown")
            across = edges.join(parents, "trace_id").groupBy(*keys).applyInArrow(_across(length), CUT)
        frequent = cut(_merged(found.where("kind = 'whole'"), cut_of(found).unionByName(across), keys), "frequent")
        parents = frequent.groupBy("trace_id").agg(F.collect_list("pattern").alias("parents"))  # the frequent patterns of one group
        if length >= SHORTEST:
            result = result.unionByName(frequent)
    return result
