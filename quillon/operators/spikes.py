"""Implausible measurements per source (problem 5).

A source's readings lie in time order in range partitions over (source, time). A source that lies inside one
partition is judged there. The outermost sources of a partition may go on in its neighbours (a heavy one fills
many), so a partition emits their rows and a bounded state instead: histograms of levels and jumps, and boundary runs.
States of a source are stitched in time order, its pieces count their readings by features, trees grow from the
merged counts, and its rows are scored piece by piece with the features and the forest of the whole source, so that
scores don't depend on where partitions end.

Per source and measurement an isolation forest over level, difference, seasonal and run-length features scores every
reading. Every reading is in the sample of a tree: a source has as many trees as its readings fill. A threshold
calibrated on the scores of all its readings tells isolated ones from ordinary ones, and an isolated reading that
lies FACTOR beyond all ordinary ones is a spike. Explicit rules find stuck runs, negative and physically impossible
values.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.skew import range_split
from quillon.runtime import cut, dim_join

DURATION = 1
BIN = 0.02  #: width of the bins of levels and jumps, in natural logarithms
LIMIT = 3.0  #: features are cut off here (a factor of 20)
FACTOR = 5  #: how far a spike lies outside the ordinary values
STUCK = 5  #: least length of a stuck run
TREES, SAMPLE, DEPTH = 16, 64, 6  #: least number of a source's trees, readings of a tree, cuts above a leaf
CHUNK = 4096  #: trees of a cut source that one task grows
PAIRS = 1 << 18  #: readings times trees that are looked at together
LOW, HIGH = 0.44, 0.53  #: scores between which a source's threshold lies
APART = 3  #: readings at most this far apart belong to one visit of a level
BESIDE = 4  #: neighbouring bins on either side that are looked at for a return to a level
ZERO = -50.0  #: level of the value 0
ISOLATED = 9  #: mark of a reading that is a spike if the source's ordinary values say so
PARTITION_ROWS = 500_000  #: rows of a range partition, held as arrays


def measurements_wide(bursts: DataFrame, events: DataFrame, traces: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per burst: source, time, one column per measurement, and the machine's limits.

    Duplicate bursts and event rows count once (the largest value of a measurement if copies differ).
    """
    types = sorted(r[0] for r in events.where(F.col("event_value").isNotNull() & F.col("event_type").isNotNull()).select("event_type").distinct().collect())
    types = [t for t in types if t != DURATION]
    e = events.where(F.col("event_value").isNotNull()).groupBy("instance").agg(
        *[F.max(F.when(F.col("event_type") == t, F.col("event_value"))).alias(f"m{t}") for t in types], F.lit(True).alias("_any"))
    b = bursts.where(F.col("instance").isNotNull()).groupBy("instance").agg(*[F.max(c).alias(c) for c in ("trace_id", "task_id", "thread_id", "begin_time")], F.max("duration").alias(f"m{DURATION}"))
    wide = b.join(e, "instance", "left")
    machine = traces.groupBy("trace_id").agg(F.max("clock_mhz").cast("long").alias("clock"), F.max("issue_width").cast("long").alias("issue"))
    return dim_join(wide, machine, ["trace_id"], "left").drop("_any"), [DURATION, *types]


# ---------------------------------------------------------------- isolation forest over many groups at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


def trees_of(size: np.ndarray) -> np.ndarray:
    """Number of trees of groups with so many readings: all of them are in some tree."""
    return np.where(size > 0, np.maximum(-(-size // SAMPLE), TREES), 0)


def numbered(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each tree, and its number in the group."""
    trees = trees_of(size)
    group = np.repeat(np.arange(len(size)), trees)
    return group, np.arange(len(group)) - (np.cumsum(trees) - trees)[group]


def shuffled(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each place in a fixed random order of so many, without a table: four mixing rounds over the next power of four, again while beyond ``size``."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    size, out = size.astype(np.uint64), place.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x, h = out[open_], half[open_]
        low = (np.uint64(1) << h) - np.uint64(1)
        for k in range(4):
            right = x & low
            x = right << h | (x >> h) ^ (_mix(right * np.uint64(4) + np.uint64(k) + (size[open_] << np.uint64(24))) >> np.uint64(20) & low)
        out[open_] = x
        open_ = open_[x >= size[open_]]
    return out.astype(np.int64)


def places(size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places among a group's ``size`` readings that its tree ``number`` samples: (trees, SAMPLE).

    The readings, in order of their features, are dealt to trees in random order. Small groups are gone through again.
    """
    n = np.repeat(size, SAMPLE)
    turn = (number[:, None] * SAMPLE + np.arange(SAMPLE)).ravel() % n
    return shuffled(turn, n).reshape(-1, SAMPLE)


def deal(size: np.ndarray) -> np.ndarray:
    """Places that the trees of all groups sample, group by group; groups of one size are dealt alike."""
    kinds, kind = np.unique(size, return_inverse=True)
    owner, number = numbered(kinds)
    first = np.cumsum(trees_of(kinds)) - trees_of(kinds)
    group, own = numbered(size)
    return places(kinds[owner], number)[first[kind[group]] + own]


def _unsuccessful(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n."""
    n = n.astype(np.float32)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772157) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1, 0)).astype(np.float32)


@dataclass
class Forest:
    """Trees of every group, one after the other, as full binary trees; ``leaf`` holds path lengths."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray


def grow(samples: np.ndarray, number: np.ndarray | None = None) -> Forest:
    """samples: (trees, SAMPLE, features), features from 0 to LIMIT; ``number`` of each tree in its group.

    A cut lies between the least value of a node and the end of the node's box, not the largest value of its
    sample, so that a far reading is cut off even by trees whose sample holds none like it.
    """
    trees, n, f = samples.shape
    inner = (1 << DEPTH) - 1
    number = np.arange(trees) if number is None else number
    x = np.ascontiguousarray(samples.reshape(trees * n, f), np.float32)
    row = np.arange(trees * n)
    tree = row // n
    node = np.zeros(trees * n, np.int64)
    feature = np.empty((trees, inner), np.int8)
    cut_at = np.empty((trees, inner), np.float32)
    ended = np.full((trees, 1), np.float32(-1))  # path length where a branch ended early
    box = np.full((trees, f), np.float32(LIMIT))
    for level in range(DEPTH):
        width, first = 1 << level, (1 << level) - 1
        key, every = tree * width + node, np.arange(trees * width)
        drawn = (number[:, None] % TREES * width + np.arange(width) + 1000 * level + 10_000 * (number[:, None] // TREES)).ravel().astype(np.uint64)
        pick = (_uniform(drawn * np.uint64(2)) * f).astype(np.int8)
        low = np.full(trees * width, np.inf, np.float32)
        value = x[row, pick[key]]
        np.minimum.at(low, key, value)
        count = np.bincount(key, minlength=trees * width)
        high = box[every, pick]
        split = (count > 1) & (high > low)
        with np.errstate(invalid="ignore"):
            at = np.where(split, low + _uniform(drawn * np.uint64(2) + np.uint64(1)) * (high - low), np.inf).astype(np.float32)
        # a node of equal values in the picked feature still counts as one of its size
        stop = np.where(count <= 1, np.float32(level), np.float32(-1)).reshape(trees, width)
        ended = np.repeat(np.where(ended >= 0, ended, stop), 2, axis=1)
        feature[:, first:first + width], cut_at[:, first:first + width] = pick.reshape(trees, width), at.reshape(trees, width)
        node = node * 2 + (value >= at[key])
        box = np.repeat(box, 2, axis=0)
        box[2 * every, pick] = np.minimum(high, at)
    count = np.bincount(tree * (inner + 1) + node, minlength=trees * (inner + 1)).reshape(trees, inner + 1)
    leaf = np.where(ended >= 0, ended, DEPTH + _unsuccessful(count))
    return Forest(feature, cut_at, leaf.astype(np.float32))


def paths(forest: Forest, x: np.ndarray, first: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Sum of each row's path lengths in ``trees`` trees from its ``first`` on, exact in whatever order trees come."""
    path = np.zeros(len(x))
    flat, f = np.ascontiguousarray(x, np.float32).ravel(), x.shape[1]
    inner = forest.feature.shape[1]
    feature, cuts, leaf = forest.feature.ravel(), forest.cut.ravel(), forest.leaf.ravel()
    ends = np.cumsum(trees)
    at = 0
    while at < len(x):
        end = max(int(np.searchsorted(ends, ends[at] - trees[at] + PAIRS, "right")), at + 1)
        row = np.repeat(np.arange(at, end), trees[at:end])
        starts = ends[at:end] - trees[at:end] - (ends[at] - trees[at])
        tree = np.arange(len(row)) - starts[row - at] + first[row]
        base, top = row * f, tree * inner
        node = np.zeros(len(row), np.int64)
        for _ in range(DEPTH):
            place = top + node
            node = 2 * node + 1 + (flat[base + feature[place]] >= cuts[place])
        path[at:end] = np.add.reduceat(leaf[tree * (inner + 1) + node - inner].astype(np.float64), starts)
        at = end
    return path


def anomaly(path: np.ndarray, trees: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Anomaly score in (0, 1) from the sum of path lengths in a group's trees and the number of its readings."""
    expected = _unsuccessful(np.minimum(size, SAMPLE))
    return np.exp2(-path / trees / np.maximum(expected, 1e-6)).astype(np.float32)


def score(forest: Forest, x: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Anomaly score of each row of ``x`` in the forest of its group; ``sizes`` are the groups' readings."""
    trees = trees_of(sizes)
    return anomaly(paths(forest, x, (np.cumsum(trees) - trees)[group], trees[group]), trees[group], sizes[group])


def thresholds(scores: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Per group the middle of the widest gap between its sorted scores, from LOW to HIGH."""
    out = np.full(n_groups, (LOW + HIGH) / 2)
    order = np.lexsort((scores, group))
    s, g = scores[order], group[order]
    a, b = np.maximum(s[:-1], LOW), np.minimum(s[1:], HIGH)
    ok = np.flatnonzero((g[1:] == g[:-1]) & (s[1:] >= LOW) & (s[:-1] <= HIGH))
    gap = np.zeros(n_groups)
    np.maximum.at(gap, g[ok], b[ok] - a[ok])
    widest = ok[(b[ok] - a[ok] == gap[g[ok]]) & (gap[g[ok]] > 0)]
    out[g[widest]] = (a[widest] + b[widest]) / 2
    return out


# ---------------------------------------------------------------- features

SPAN = 1 << 20
STEPS, RUNS = round(LIMIT / BIN) + 1, int(np.exp(LIMIT)) + 2  #: values of a feature that is a distance, and of run lengths
CODES = STEPS**3 * RUNS


@dataclass
class Histogram:
    """Rows of (source, bin): count, and first and last position, sorted by source and bin."""

    source: np.ndarray
    bin: np.ndarray
    count: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, source: np.ndarray, bins: np.ndarray, count: np.ndarray, first: np.ndarray, last: np.ndarray) -> Histogram:
        key, inv = np.unique(source * SPAN + bins + SPAN // 2, return_inverse=True)
        low, high, n = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), -1), np.zeros(len(key), np.int64)
        np.minimum.at(low, inv, first)
        np.maximum.at(high, inv, last)
        np.add.at(n, inv, count)
        return cls(key // SPAN, key % SPAN - SPAN // 2, n, low, high)

    def find(self, source: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.source * SPAN + self.bin, source * SPAN + bins)

    def beside(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th row before (below 0) or after each row, and its distance in bins, far beyond the source's ends."""
        at = np.arange(len(self.bin)) + k
        ok = (at >= 0) & (at < len(at))
        at = np.clip(at, 0, max(len(at) - 1, 0))
        return at, np.where(ok & (self.source[at] == self.source), np.abs(self.bin[at] - self.bin), SPAN)


def features(source: np.ndarray, level: np.ndarray, jump: np.ndarray, pos: np.ndarray, run_size: np.ndarray, levels: Histogram, jumps: Histogram) -> np.ndarray:
    """Four features of each reading as one code (see ``vectors``), each 0 for the most ordinary one and at most LIMIT.

    Level: distance to the second nearest of the source's other levels. Difference: distance of the jump from the
    reading before to the nearest other jump of the source. Seasonal: distance to the nearest level seen in another
    visit, more than APART readings before or after. Run length: logarithm.
    """
    if not len(level):
        return np.zeros(0, np.int64)
    at = levels.find(source, level)
    (l1, dl), (r1, dr) = levels.beside(-1), levels.beside(1)
    left = np.where(levels.count[l1] > 1, dl, levels.beside(-2)[1])
    right = np.where(levels.count[r1] > 1, dr, levels.beside(2)[1])
    nearest = np.minimum(dl, dr)
    second = np.sort(np.stack([dl, left, dr, right]), 0)[1]
    out = np.where(levels.count >= 3, 0, np.where(levels.count == 2, nearest, second))[at]
    back = np.full(len(level), SPAN)
    for k in (0, *[s * i for i in range(1, BESIDE + 1) for s in (-1, 1)]):
        there, far = levels.beside(k)
        there, far = there[at], far[at]
        seen = (far < back) & ((pos - levels.first[there] > APART) | (levels.last[there] - pos > APART))
        back[seen] = far[seen]
    step = np.minimum(jumps.beside(-1)[1], jumps.beside(1)[1])
    step = np.where(jumps.count > 1, 0, step)[jumps.find(source, jump)]
    code = np.zeros(len(level), np.int64)
    for far in (out, step, back):
        code = code * STEPS + np.minimum(far, STEPS - 1)
    return code * RUNS + np.minimum(run_size, RUNS - 1)


def vectors(code: np.ndarray) -> np.ndarray:
    """The features as numbers: (readings, 4)."""
    far = code // RUNS
    distances = [far // STEPS**2 * BIN, far // STEPS % STEPS * BIN, far % STEPS * BIN]
    return np.minimum(np.stack([*distances, np.log(code % RUNS)], 1), LIMIT).astype(np.float32)


@dataclass
class Readings:
    """Present readings of one measurement in (source, time) order."""

    row: np.ndarray
    value: np.ndarray
    source: np.ndarray
    n_sources: int
    start: np.ndarray = field(init=False)  # per source
    size: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = np.bincount(self.source, minlength=self.n_sources)
        self.start = np.cumsum(self.size) - self.size
        new = np.r_[True, (self.value[1:] != self.value[:-1]) | (self.source[1:] != self.source[:-1])][: len(self.value)]
        self.run = np.cumsum(new) - 1
        self.run_size = np.bincount(self.run) if len(new) else np.zeros(0, np.int64)
        self.runs_of = np.bincount(self.source[new], minlength=self.n_sources) if len(new) else np.zeros(self.n_sources, np.int64)
        v = self.value
        level = np.where(v > 0, np.log(np.maximum(v, 1).astype(np.float64)), np.where(v == 0, ZERO, 2 * ZERO))
        self.level = np.round(level / BIN).astype(np.int64)
        self.jump = np.zeros(len(v), np.int64)  # a source's first reading has none
        self.jump[1:] = np.where(self.source[1:] == self.source[:-1], np.diff(self.level), 0)
        self.pos = np.arange(len(v)) - self.start[self.source]

    def levels(self) -> Histogram:
        return Histogram.of(self.source, self.level, np.ones_like(self.level), self.pos, self.pos)

    def jumps(self, rows: np.ndarray | slice = slice(None)) -> Histogram:
        return Histogram.of(self.source[rows], self.jump[rows], np.ones_like(self.jump[rows]), self.pos[rows], self.pos[rows])

    def isolated(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each reading, and whether the forest of all readings of its source isolates it."""
        key, of, count = np.unique(self.source * CODES + code, return_inverse=True, return_counts=True)
        x, owner = vectors(key % CODES), key // CODES
        group, number = numbered(self.size)
        sampled = np.repeat(np.arange(len(key)), count)[deal(self.size) + self.start[group][:, None]]
        found = score(grow(x[sampled], number), x, owner, self.size)
        return found[of], (found >= thresholds(found, owner, self.n_sources)[owner])[of]


def far_from(v: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.isfinite(largest) & ((v > FACTOR * largest) | (v * FACTOR < least))


def rules(r: Readings, run_size: np.ndarray, constant: np.ndarray, isolated: np.ndarray) -> np.ndarray:
    """Kind of fault per reading so far: 0 none, ISOLATED, 2 stuck, 3 negative."""
    kind = np.where(isolated, ISOLATED, 0).astype(np.int8)
    kind[(run_size >= STUCK) & ~constant[r.source]] = 2
    kind[r.value < 0] = 3
    return kind


def ordinary(r: Readings, isolated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value per source that the forest doesn't isolate (inf and -inf where there is none)."""
    least, largest = np.full(r.n_sources, np.inf), np.full(r.n_sources, -np.inf)
    own = ~isolated & (r.value >= 0)
    np.minimum.at(least, r.source[own], r.value[own].astype(np.float64))
    np.maximum.at(largest, r.source[own], r.value[own].astype(np.float64))
    return least, largest


class Piece:
    """The rows of one partition (or of one piece of a source) as arrays."""

    KEYS = ("trace_id", "task_id", "thread_id")

    def __init__(self, table: pa.Table, types: list[int]) -> None:
        self.types = types
        get = lambda c: table.column(c).fill_null(-1).to_numpy()
        self.instance, self.clock, self.issue, self.time = (get(c).astype(np.int64) for c in ("instance", "clock", "issue", "begin_time"))
        keys = [get(c) for c in self.KEYS]
        self.new = np.ones(len(self.instance), bool)
        if len(self.new):
            self.new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        self.source = np.cumsum(self.new) - 1
        self.n_sources = int(self.new.sum())
        self.keys = [k[self.new] for k in keys]
        self.present = {t: table.column(f"m{t}").is_valid().to_numpy() for t in types}
        self.values = {t: get(f"m{t}").astype(np.int64) for t in types}

    def readings(self, t: int) -> Readings:
        at = np.flatnonzero(self.present[t])
        return Readings(at, self.values[t][at], self.source[at], self.n_sources)

    def marks(self) -> dict[str, dict[int, np.ndarray]]:
        return {"k": {t: np.zeros(len(self.instance), np.int8) for t in self.types}, "s": {t: np.zeros(len(self.instance), np.float32) for t in self.types}}

    def limits(self, kinds: dict[int, np.ndarray]) -> None:
        """Physical limits: cycles by time and clock, instructions by cycles and issue width."""
        cycles, instructions = 42000059, 42000050
        f = {t: v.astype(np.float64) for t, v in self.values.items()}
        if cycles in kinds:
            over = f[cycles] * 1000 > f[DURATION] * self.clock
            known = self.present[cycles] & self.present[DURATION] & (kinds[DURATION] == 0) & (self.clock >= 0)
            kinds[cycles][over & known & (kinds[cycles] == 0)] = 4
        if cycles in kinds and instructions in kinds:
            over = f[instructions] > f[cycles] * self.issue
            known = self.present[cycles] & self.present[instructions] & (kinds[cycles] == 0) & (self.issue >= 0)
            kinds[instructions][over & known & (kinds[instructions] == 0)] = 4

    def decide(self, kinds: dict[int, np.ndarray], bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Isolated readings become spikes or none by the ordinary values of their source, then the limits are looked at."""
        for t in self.types:
            at = np.flatnonzero(kinds[t] == ISOLATED)
            kinds[t][at] = far_from(self.values[t][at].astype(np.float64), *(b[at] for b in bounds[t]))
        self.limits(kinds)

    def cases(self, marks: dict[str, dict[int, np.ndarray]]) -> dict[str, np.ndarray]:
        out: dict[str, list] = {"instance": [], "event_type": [], "fault": [], "score": []}
        for t in self.types:
            at = np.flatnonzero(marks["k"][t])
            for name, x in zip(out, (self.instance[at], np.full(len(at), t, np.int64), marks["k"][t][at], marks["s"][t][at])):
                out[name].append(x)
        return {k: np.concatenate(v) for k, v in out.items()}


def judge_whole(piece: Piece) -> dict[str, np.ndarray]:
    """Faults of sources that lie in the piece as a whole."""
    marks, bounds = piece.marks(), {}
    for t in piece.types:
        r = piece.readings(t)
        if len(r.value):
            found, isolated = r.isolated(features(r.source, r.level, r.jump, r.pos, r.run_size[r.run], r.levels(), r.jumps()))
            marks["k"][t][r.row], marks["s"][t][r.row] = rules(r, r.run_size[r.run], r.runs_of <= 1, isolated), found
        else:
            isolated = np.zeros(0, bool)
        bounds[t] = tuple(b[piece.source] for b in ordinary(r, isolated))
    piece.decide(marks["k"], bounds)
    return piece.cases(marks)


KINDS = ["", "spike", "stuck", "negative", "over physical limit"]

# ---------------------------------------------------------------- sources that cross partitions


def state_of(r: Readings) -> dict | None:
    """Bounded, mergeable state of one source in one piece."""
    n = len(r.value)
    if not n:
        return None
    return {"n": n, "levels": r.levels(), "jumps": r.jumps(slice(1, None)), "ends": (int(r.level[0]), int(r.level[-1])),
            "head": (int(r.value[0]), int(r.run_size[0])), "tail": (int(r.value[-1]), int(r.run_size[-1])), "runs": len(r.run_size)}


def stitch(states: list[dict | None]) -> tuple[dict | None, list[dict]]:
    """Facts of a source from its pieces' states in time order, and what each piece has to know of those around it."""
    some = [(i, s) for i, s in enumerate(states) if s]
    parts: list[dict] = [{"offset": 0, "before": None, "ends": (0, 0)} for _ in states]
    if not some:
        return None, parts
    n, before, across = 0, None, [0]  # the first reading's jump is 0
    for i, s in some:
        parts[i].update(offset=n, before=before)
        if before is not None:
            across.append(s["ends"][0] - before)
        n, before = n + s["n"], s["ends"][1]
    chains: list[list[int]] = []  # (value, size) of runs over the bounds
    where = {}
    for i, s in some:
        if chains and chains[-1][0] == s["head"][0]:
            chains[-1][1] += s["head"][1]
        else:
            chains.append(list(s["head"]))
        where[i] = [len(chains) - 1] * 2
        if s["runs"] > 1:
            chains.append(list(s["tail"]))
            where[i][1] = len(chains) - 1
    for i, (h, t) in where.items():
        parts[i]["ends"] = (chains[h][1], chains[t][1])
    zero = lambda k: np.zeros(k, np.int64)
    both = lambda name, part, shift: np.concatenate([getattr(s[name], part) + (parts[i]["offset"] if shift else 0) for i, s in some])
    levels = Histogram.of(*[both("levels", p, p in ("first", "last")) for p in ("source", "bin", "count", "first", "last")])
    jumps = Histogram.of(np.r_[both("jumps", "source", False), zero(len(across))], np.r_[both("jumps", "bin", False), across],
                         np.r_[both("jumps", "count", False), zero(len(across)) + 1], np.r_[both("jumps", "first", True), zero(len(across))], np.r_[both("jumps", "last", True), zero(len(across))])
    return {"levels": levels, "jumps": jumps, "constant": len(chains) == 1}, parts


KEYED = "trace_id long, task_id long, thread_id long"
JUDGED = f"kind string, instance long, event_type long, fault string, score double, {KEYED}, piece long, time long, blob binary"
STITCHED = f"{KEYED}, piece long, blob binary"
COUNTED = f"{KEYED}, event_type long, trees long, blob binary"


def _rows_out(schema: str, n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "byte": pa.int8(), "float": pa.float32()}
    arrays, names = [], []
    for part in schema.split(", "):
        name, sort = part.split(" ")
        names.append(name)
        arrays.append(pa.array(columns[name], types[sort]) if name in columns else pa.nulls(n, types[sort]))
    return pa.RecordBatch.from_arrays(arrays, names)


def _cases_out(found: dict[str, np.ndarray], schema: str) -> pa.RecordBatch:
    n = len(found["instance"])
    return _rows_out(schema, n, kind=np.full(n, "case", object), instance=found["instance"], event_type=found["event_type"],
                     fault=[KINDS[k] for k in found["fault"]], score=found["score"].astype(np.float64))


def _judge_partition(types: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got).combine_chunks()
        del got
        bounds = np.r_[np.flatnonzero(Piece(whole.select([*Piece.KEYS, "instance", "clock", "issue", "begin_time"]), []).new), whole.num_rows].tolist()
        inner = whole.slice(bounds[1], bounds[-2] - bounds[1]) if len(bounds) > 3 else whole.slice(0, 0)
        if inner.num_rows:
            yield _cases_out(judge_whole(Piece(inner.combine_chunks(), types)), JUDGED)
        for s in sorted({0, len(bounds) - 2}):
            own = whole.slice(bounds[s], bounds[s + 1] - bounds[s]).combine_chunks()
            piece = Piece(own, types)
            at = {"piece": [(number << 32) + s], "time": [int(piece.time[0])]}
            state = pickle.dumps({t: state_of(piece.readings(t)) for t in types})
            yield _rows_out(JUDGED, 1, kind=["state"], **{k: [int(v[0])] for k, v in zip(Piece.KEYS, piece.keys)}, **at, blob=[state])
            for first in range(0, own.num_rows, 2000):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as w:
                    w.write_table(own.slice(first, 2000).combine_chunks())
                yield _rows_out(JUDGED, 1, kind=["rows"], **at | {"time": [first]}, blob=[sink.getvalue().to_pybytes()])

    return run


def _stitch_source(table: pa.Table) -> pa.Table:
    """The source's facts for each of its pieces."""
    table = table.sort_by("piece")
    states = [pickle.loads(b) for b in table.column("blob").to_pylist()]
    facts = {t: stitch([s[t] for s in states]) for t in states[0]}
    blobs = [pickle.dumps({t: (f, parts[i]) for t, (f, parts) in facts.items()}) for i in range(len(states))]
    keys = {k: table.column(k).to_numpy() for k in Piece.KEYS}
    return pa.Table.from_batches([_rows_out(STITCHED, len(states), **keys, piece=table.column("piece").to_numpy(), blob=blobs)])


def _scored(types: list[int]) -> str:
    """Rows of cut sources that may hold a fault (their marks and scores), and per piece the range of ordinary values."""
    each = [f"{n}{t} {k}" for t in types for n, k in (("m", "long"), ("k", "byte"), ("s", "float"), ("lo", "double"), ("hi", "double"))]
    return ", ".join([f"kind string, {KEYED}, instance long, begin_time long, clock long, issue long", *each])


def _opened(rows: pa.Table, facts: bytes, types: list[int]) -> tuple[Piece, dict]:
    """A piece of a cut source; per measurement its readings, sizes of their runs, features by the whole source, and if that is constant."""
    rows = rows.sort_by("time")
    whole = pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in rows.column("blob").to_pylist()]).combine_chunks()
    piece, own = Piece(whole, types), {}
    for t, (f, part) in pickle.loads(facts).items():
        r = piece.readings(t)
        if f is None or not len(r.value):
            continue
        size = r.run_size.copy()
        size[-1], size[0] = part["ends"][1], part["ends"][0]
        jump = r.jump.copy()
        jump[0] = 0 if part["before"] is None else r.level[0] - part["before"]
        code = features(r.source, r.level, jump, r.pos + part["offset"], size[r.run], f["levels"], f["jumps"])
        own[t] = r, size[r.run], code, f["constant"]
    return piece, own


def _count_piece(types: list[int]):
    """The readings of a piece by their features."""

    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        if not rows.num_rows or not facts.num_rows:
            return pa.Table.from_batches([_rows_out(COUNTED, 0)])
        piece, own = _opened(rows, facts.column("blob")[0].as_py(), types)
        blobs = [pickle.dumps(np.unique(code, return_counts=True)) for _, _, code, _ in own.values()]
        keys = {k: np.full(len(own), v[0]) for k, v in zip(Piece.KEYS, piece.keys)}
        return pa.Table.from_batches([_rows_out(COUNTED, len(own), **keys, event_type=list(own), blob=blobs)])

    return run


def _one_row(table: pa.Table, blob: tuple, trees: int) -> pa.Table:
    keys = {k: table.column(k).to_numpy()[:1] for k in (*Piece.KEYS, "event_type")}
    return pa.Table.from_batches([_rows_out(COUNTED, 1, **keys, trees=[trees], blob=[pickle.dumps(blob)])])


def _merge_counts(table: pa.Table) -> pa.Table:
    """All readings of a source and measurement by their features, and the number of their trees."""
    codes, counts = (np.concatenate(c) for c in zip(*[pickle.loads(b) for b in table.column("blob").to_pylist()]))
    code, of = np.unique(codes, return_inverse=True)
    count = np.zeros(len(code), np.int64)
    np.add.at(count, of, counts)
    return _one_row(table, (code, count), int(trees_of(count.sum())))


def _grow_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path lengths of all features in one chunk of a source's trees."""
    for batch in batches:
        paths_of = []
        for blob, trees, chunk in zip(*(batch.column(c).to_pylist() for c in ("blob", "trees", "chunk"))):
            code, count = pickle.loads(blob)
            number = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, trees))
            x, ends = vectors(code), np.cumsum(count)
            forest = grow(x[np.searchsorted(ends, places(np.full(len(number), ends[-1]), number), "right")], number)
            paths_of.append(pickle.dumps((code, int(ends[-1]), paths(forest, x, np.zeros(len(x), np.int64), np.full(len(x), len(number))))))
        keys = {c: batch.column(c) for c in (*Piece.KEYS, "event_type", "trees")}
        yield _rows_out(COUNTED, len(paths_of), **keys, blob=paths_of)


def _score_counts(table: pa.Table) -> pa.Table:
    """Scores of a source's features over all its trees, and which are isolated."""
    codes, sizes, sums = zip(*[pickle.loads(b) for b in table.column("blob").to_pylist()])
    code, trees, own = codes[0], table.column("trees")[0].as_py(), np.zeros(len(codes[0]), np.int64)
    found = anomaly(np.sum(sums, axis=0), np.full(len(code), trees), np.full(len(code), sizes[0]))
    return _one_row(table, (code, found, found >= thresholds(found, own, 1)[own]), trees)


def _score_piece(types: list[int]):
    schema = _scored(types)

    def run(rows: pa.Table, facts: pa.Table) -> pa.Table:
        if not rows.num_rows or not facts.num_rows:
            return pa.Table.from_batches([_rows_out(schema, 0)])
        blobs = dict(zip(facts.column("event_type").to_pylist(), facts.column("blob").to_pylist()))
        piece, own = _opened(rows, blobs[None], types)
        marks, range_of = piece.marks(), {}
        for t, (r, size, code, constant) in own.items():
            known, found, isolated = pickle.loads(blobs[t])
            at = np.searchsorted(known, code)
            marks["s"][t][r.row] = found[at]
            marks["k"][t][r.row] = rules(r, size, np.array([constant]), isolated[at])
            range_of[t] = ordinary(r, isolated[at])
        trial = {t: k.copy() for t, k in marks["k"].items()}
        some = np.any([k != 0 for k in trial.values()], axis=0)
        for k in trial.values():
            k[:] = 0
        piece.limits(trial)  # over a limit unless another reading of the row is a fault
        at = np.flatnonzero(some | np.any([k != 0 for k in trial.values()], axis=0))
        n = len(at)
        keys = {k: np.full(n, v[0]) for k, v in zip(Piece.KEYS, piece.keys)}
        columns = {f"m{t}": pa.array(piece.values[t][at], pa.int64(), mask=~piece.present[t][at]) for t in types}
        columns |= {f"{c}{t}": marks[c][t][at] for t in types for c in ("k", "s")}
        found = _rows_out(schema, n, kind=np.full(n, "row", object), **keys, instance=piece.instance[at], begin_time=piece.time[at], clock=piece.clock[at], issue=piece.issue[at], **columns)
        ends = {f"{c}{t}": v for t, b in range_of.items() for c, v in zip(("lo", "hi"), b)}
        return pa.Table.from_batches([found, _rows_out(schema, 1, kind=["range"], **{k: v[:1] for k, v in zip(Piece.KEYS, piece.keys)}, **ends)])

    return run


def _decide(types: list[int]):
    schema = "instance long, event_type long, fault string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            piece = Piece(table, types)
            marks = {c: {t: table.column(f"{c}{t}").to_numpy().copy() for t in types} for c in ("k", "s")}
            bounds = {t: tuple(table.column(f"{c}{t}").fill_null(v).to_numpy() for c, v in (("lo", np.inf), ("hi", -np.inf))) for t in types}
            piece.decide(marks["k"], bounds)
            yield _cases_out(piece.cases(marks), schema)

    return run


def implausible(bursts: DataFrame, events: DataFrame, traces: DataFrame) -> DataFrame:
    """Faulty measurements: instance, event_type (1 for duration), fault and the forest's score.

    Null values are no measurements. Bursts without an instance are left out; a null task or thread counts
    as one of its own, a trace without machine data has no physical limits. Ties of begin_time are ordered
    by instance. A source all of whose readings are isolated has no ordinary value and no spikes. Values above 2^53
    are compared with ratios in double precision. Empty tables give an empty result; other columns are ignored.
    """
    wide, types = measurements_wide(bursts, events, traces)
    columns = ["instance", "trace_id", "task_id", "thread_id", "begin_time", "clock", "issue", *[f"m{t}" for t in types]]
    wide = cut(wide.select(*columns), "measurements")
    # null keys sort first and are told apart from all ids, which are not negative
    number = wide.count()
    ranged = range_split(wide, list(Piece.KEYS), ["begin_time", "instance"], number, PARTITION_ROWS)
    judged = cut(ranged.mapInArrow(_judge_partition(types), JUDGED), "implausible")
    names = ["instance", "event_type", "fault", "score"]
    states = judged.where("kind = 'state'").select(*Piece.KEYS, "piece", "time", "blob")
    facts = cut(states.groupBy(*Piece.KEYS).applyInArrow(_stitch_source, STITCHED), "facts")
    rows = judged.where("kind = 'rows'").select("piece", "time", "blob")
    by = [*Piece.KEYS, "event_type"]
    counts = rows.groupBy("piece").cogroup(facts.select("piece", "blob").groupBy("piece")).applyInArrow(_count_piece(types), COUNTED)
    counts = counts.groupBy(*by).applyInArrow(_merge_counts, COUNTED).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (trees - 1) div {CHUNK})")))
    # a set number of partitions, as a chunk has few bytes and much work: eight chunks each, if all sources are cut
    parts = max(int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")), number * len(types) // (8 * CHUNK * SAMPLE))
    chunks = counts.repartition(parts, *by, "chunk").mapInArrow(_grow_chunk, COUNTED)
    forests = cut(chunks.groupBy(*by).applyInArrow(_score_counts, COUNTED), "forests")
    known = dim_join(forests, facts.select(*Piece.KEYS, "piece"), list(Piece.KEYS)).select("piece", "event_type", "blob")
    known = known.unionByName(facts.select("piece", F.lit(None).cast("long").alias("event_type"), "blob"))
    scored = cut(rows.groupBy("piece").cogroup(known.groupBy("piece")).applyInArrow(_score_piece(types), _scored(types)), "scored")
    ends = [f(f"{n}{t}").alias(f"{n}{t}") for t in types for n, f in (("lo", F.min), ("hi", F.max))]
    ranges = scored.where("kind = 'range'").groupBy(*Piece.KEYS).agg(*ends)
    opened = dim_join(scored.where("kind = 'row'").drop("kind", *[f"{n}{t}" for t in types for n in ("lo", "hi")]), ranges, list(Piece.KEYS))
    decided = opened.mapInArrow(_decide(types), "instance long, event_type long, fault string, score double")
    return judged.where("kind = 'case'").select(*names).unionByName(decided)
