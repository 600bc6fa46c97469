"""Sequences of cluster ids per thread, their alignment, and scores of clusters over aligned columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranks import ranked
from quillon.runtime import cut

GAP = -1
LETTERS = "ABCDEFGHIKLMNPQRSTVWYZ"  #: fixed values: letters of the ids 0..21
OPEN_COST = EXTEND_COST = 50.0


def positions(bursts: DataFrame, keys: Sequence[str] = ("task_id", "thread_id"), order: str = "instance") -> DataFrame:
    """The position of each burst in the sequence of its thread."""
    return ranked(bursts, list(keys), [order], "position")


def as_letters(sequence: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """K9: ids 0..21 as letters, others as X, gaps as -."""
    c = F.col(cluster)
    return sequence.withColumn("letter", F.when(c.isNull(), "-").when(c.between(0, len(LETTERS) - 1), F.substring(F.lit(LETTERS), c + 1, F.lit(1))).otherwise("X"))


def _column(aligned: DataFrame) -> list[str]:
    """What tells columns apart: where sequences are cut into windows, each numbers its own from 0."""
    return ["window", "col"] if "window" in aligned.columns else ["col"]


def column_occupancy(aligned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """A10: rows of each cluster in each aligned column, gaps left out."""
    return aligned.where(F.col(cluster).isNotNull()).groupBy(*_column(aligned), cluster).agg(F.count(F.lit(1)).alias("occurrences"))


def score_by_cluster(aligned: DataFrame, weights: DataFrame, threads: int, cluster: str = "cluster_id") -> DataFrame:
    """Mean share of threads over the columns where a cluster appears, its occurrences, and that times its share of time."""
    per = column_occupancy(aligned, cluster).groupBy(cluster).agg(F.avg(F.col("occurrences") / threads).alias("score"), F.sum("occurrences").alias("occurrences"))
    return per.join(weights, cluster, "left").withColumn("weighted", F.col("score") * F.coalesce("weight", F.lit(0.0)))


def identical_columns(aligned: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Sets of clusters (of two or more) that occupy the same aligned columns; cluster and the least of its set.

    Clusters with equal counts and sums of hashes of their columns are compared column by column with the least of them.
    """
    keys = _column(aligned)
    sets = cut(aligned.where(F.col(cluster).isNotNull()).select(cluster, *keys).distinct().withColumn("_h", F.xxhash64(*keys)), "columns")
    prints = sets.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("_s"))
    least = prints.groupBy("_n", "_s").agg(F.min(cluster).alias("merged"), F.count(F.lit(1)).alias("_of")).where("_of > 1")
    pairs = prints.join(least, ["_n", "_s"]).select(cluster, "merged", "_n")
    theirs = sets.select(F.col(cluster).alias("merged"), *keys)
    equal = sets.join(pairs, cluster).join(theirs, ["merged", *keys]).groupBy(cluster, "merged").agg(F.count(F.lit(1)).alias("_same"), F.max("_n").alias("_n"))
    return equal.where("_same = _n").select(cluster, "merged")


# ---------------------------------------------------------------- alignment


def substitution(weights: dict[int, float], top: int) -> np.ndarray:
    """Scores of two ids: a match by share of time, with larger ids lower; a mismatch the mean of the two; noise counts as the other."""
    n = top + 1
    own = np.array([2 * 100 * weights.get(i, 0.0) + top - i for i in range(n)])
    share = np.array([100 * weights.get(i, 0.0) for i in range(n)])
    out = (share[:, None] + share[None, :]) / 2
    out[0, :], out[:, 0] = share, share
    out[np.arange(n), np.arange(n)] = own
    return out


def _fill(row, n: int, lengths: np.ndarray, end_gap: float) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Moves (0 both, 1 only a, 2 only b) of the global alignments of one a of length n with several b, and their scores; ``row`` gives the scores of a's i-th column with all columns of all b.

    A row's moves along b depend on each other only by a running maximum of what is left after their gaps.
    """
    p, m = len(lengths), int(lengths.max(initial=0))
    along = np.arange(m + 1)
    up_cost = np.where(along[None, 1:] == lengths[:, None], end_gap, OPEN_COST)
    move = np.zeros((n + 1, p, m + 1), np.int8)
    move[1:, :, 0], move[0, :, 1:] = 1, 2
    last = np.broadcast_to(-end_gap * along, (p, m + 1)).copy()
    for i in range(1, n + 1):
        up, diagonal = last[:, 1:] - up_cost, last[:, :-1] + row(i - 1)
        best = np.maximum(diagonal, up)
        left_cost = end_gap if i == n else OPEN_COST
        now = np.empty_like(last)
        now[:, 0] = -end_gap * i
        now[:, 1:] = best
        now = np.maximum.accumulate(now + left_cost * along, 1) - left_cost * along
        left = best < now[:, :-1] - left_cost
        now[:, 1:] = np.where(left, now[:, 1:], best)
        now[:, 0] = -end_gap * i
        move[i, :, 1:] = np.where(left, 2, diagonal < up)
        last = now
    return move, last[np.arange(p), lengths]


def pair_score(a: np.ndarray, b: np.ndarray, match: np.ndarray, end_gap: float) -> tuple[np.ndarray, float]:
    """Global alignment of two profiles (columns x ids); the moves (0 both, 1 only a, 2 only b) and the score."""
    scores = a @ match @ b.T
    i, j = scores.shape
    move, total = _fill(lambda k: scores[k], i, np.array([j]), end_gap)
    path = []
    while i or j:
        k = int(move[i, 0, j])
        path.append(k)
        i, j = i - (k != 2), j - (k != 1)
    return np.array(path[::-1], np.int8), float(total[0])


def likeness(a: np.ndarray, others: list[np.ndarray], match: np.ndarray, end_gap: float) -> np.ndarray:
    """Share of equal ids in the alignments of ``a`` with each of ``others``."""
    lengths = np.array([len(o) for o in others])
    b = np.zeros((len(others), int(lengths.max(initial=0))), int)
    for k, o in enumerate(others):
        b[k, :len(o)] = o
    move, _ = _fill(lambda k: match[a[k]][b], len(a), lengths, end_gap)
    which = np.arange(len(others))
    i, j, same = np.full(len(others), len(a)), lengths.copy(), np.zeros(len(others), int)
    while (i + j).any():
        k = move[i, which, j]
        ended = (i + j) == 0
        both = (k == 0) & ~ended
        at = np.flatnonzero(both)
        same[at] += a[i[at] - 1] == b[at, j[at] - 1]
        i, j = i - ((k != 2) & ~ended), j - ((k != 1) & ~ended)
    return same / np.maximum(1, np.minimum(lengths, len(a)))


PAIR_CELLS = 1 << 25  #: moves of so many cells are kept while pairs are compared


def align(sequences: list[list[int]], weights: dict[int, float]) -> np.ndarray:
    """Progressive alignment; (threads, columns) of ids with GAP.

    Equal sequences are aligned as one. Pairs are compared by the share of equal ids in their alignment, a tree
    joins the most similar (average linkage, ties by order), and profiles are aligned along it.
    """
    distinct = sorted(set(map(tuple, sequences)))
    where = {s: i for i, s in enumerate(distinct)}
    ids = np.array(sorted({i for s in distinct for i in s}), int)
    match = substitution(weights, int(ids.max(initial=0)))[np.ix_(ids, ids)]
    end_gap = 100 * min((w for w in weights.values() if w > 0), default=0.01)
    coded = [np.searchsorted(ids, np.array(s, int)) for s in distinct]
    n, kinds = len(distinct), len(ids)

    def profile(rows: np.ndarray) -> np.ndarray:
        r, c = np.nonzero(rows != GAP)
        return np.bincount(c * kinds + rows[r, c], minlength=rows.shape[1] * kinds).reshape(-1, kinds) / len(rows)

    total = np.full((n, n), -np.inf)  # sums of likenesses between groups; a group has the number of its first sequence
    longest = max(map(len, coded), default=0) + 1
    for x in range(n):
        some = max(1, PAIR_CELLS // ((len(coded[x]) + 1) * longest))
        for y in range(x + 1, n, some):
            total[x, y:y + some] = likeness(coded[x], coded[y:y + some], match, end_gap)
    size = np.ones(n)
    groups = {i: ([i], coded[i].reshape(1, -1)) for i in range(n)}
    while len(groups) > 1:
        p, q = divmod(int(np.argmax(np.round(total / np.outer(size, size), 12))), n)
        (mp, a), (mq, b) = groups.pop(p), groups.pop(q)
        path, _ = pair_score(profile(a), profile(b), match, end_gap)
        ca, cb = np.full((len(a), len(path)), GAP), np.full((len(b), len(path)), GAP)
        ca[:, path != 2], cb[:, path != 1] = a, b
        groups[p] = (mp + mq, np.vstack([ca, cb]))
        for o in groups:
            if o != p:
                total[min(o, p), max(o, p)] += total[min(o, q), max(o, q)]
        size[p] += size[q]
        total[q, :] = total[:, q] = -np.inf
    members, rows = next(iter(groups.values())) if groups else ([], np.zeros((0, 0), int))
    rows = np.where(rows == GAP, GAP, ids[rows]) if kinds else rows
    at = {m: i for i, m in enumerate(members)}
    return np.stack([rows[at[where[tuple(s)]]] for s in sequences]) if sequences else rows


def aligned_sequences(bursts: DataFrame, weights: DataFrame, group: str = "trace_id", keys: Sequence[str] = ("task_id", "thread_id"), order: str = "instance", cluster: str = "cluster_id", most: int | None = None) -> DataFrame:
    """C22 for each group: (group, keys, window, col, cluster); gaps have a null cluster.

    An alignment is a global computation over its sequences, so a group is aligned in one task, which holds its
    whole sequences. With ``most`` they are cut into windows of so many positions, each aligned by itself with
    columns from 0 again; shifts over a cut are lost then. ``weights`` has (group, cluster, weight), the
    clusters' shares of time.
    """
    window = F.lit(0).cast("long") if most is None else F.floor((F.col("_pos") - 1) / most)
    placed = ranked(bursts.select(group, *keys, order, cluster), [group, *keys], [order], "_pos").withColumn("_window", window)
    kinds = dict(bursts.dtypes)
    schema = ", ".join([f"{group} {kinds[group]}", *[f"{k} {kinds[k]}" for k in keys], "window long", "col long", f"{cluster} {kinds[cluster]}"])

    def run(rows: pa.Table, shares: pa.Table) -> pa.Table:
        own = dict(zip(shares.column(cluster).to_pylist(), shares.column("weight").to_pylist()))
        part = rows.to_pandas().sort_values([*keys, "_pos"])
        types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        names, lists = [], []
        for name, own_rows in part.groupby(list(keys)):
            names.append(name if isinstance(name, tuple) else (name,))
            lists.append(own_rows[cluster].tolist())
        ids = align(lists, own) if lists else np.zeros((0, 0), int)
        n, width = ids.shape
        out = {group: pa.array([part[group].iloc[0]] * (n * width) if n else [], types[kinds[group]])}
        for k, values in zip(keys, zip(*names) if names else [()] * len(keys)):
            out[k] = pa.array(np.repeat(np.array(values), width), types[kinds[k]])
        out["window"] = pa.array(np.full(n * width, part["_window"].iloc[0] if n else 0), pa.int64())
        out["col"] = pa.array(np.tile(np.arange(width), n), pa.int64())
        out[cluster] = pa.array(ids.ravel(), types[kinds[cluster]], mask=ids.ravel() == GAP)
        return pa.table(out)

    placed = cut(placed, "placed")
    shares = weights.select(group, cluster, "weight").join(placed.select(F.col(group).alias(group), F.col("_window").alias("_w")).distinct(), group)
    return placed.groupBy(group, "_window").cogroup(shares.groupBy(group, "_w")).applyInArrow(run, schema)


def sequence_lines(aligned: DataFrame, keys: Sequence[str] = ("task_id", "thread_id"), cluster: str = "cluster_id") -> DataFrame:
    """K9: one row per thread with its ids or - by column."""
    own = F.sort_array(F.collect_list(F.struct(*_column(aligned), F.coalesce(F.col(cluster).cast("string"), F.lit("-")).alias("v"))))
    return aligned.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["v"]), ",").alias("sequence"))
