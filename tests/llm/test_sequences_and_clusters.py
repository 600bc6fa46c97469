"""Frequent subsequences and similarity clusters against brute force."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import clusters as C
from quillon.llm.sequences import frequent_subsequences

BURSTS = "instance long, trace_id long, task_id long, thread_id long, begin_time long, cluster_id int, need string, duration long"


def contained(seq, length):
    found = set()
    for start in range(len(seq)):
        for gaps in itertools.product((1, 2, 3), repeat=length - 1):
            at = start + np.cumsum((0, *gaps))
            if at[-1] < len(seq):
                found.add("-".join(str(seq[i]) for i in at))
    return found


def brute_patterns(rows, share=0.6):
    seqs = {}
    for i, tr, ta, th, t, c, *_ in sorted(set(r[:6] for r in rows if None not in r[:6]), key=lambda r: (r[4], r[0])):
        if c >= 6:
            seqs.setdefault((tr, ta, th), []).append(c)
    out = {}
    for tr in {k[0] for k in seqs}:
        own = [s for k, s in seqs.items() if k[0] == tr]
        counts = {}
        for s in own:
            for p in contained(s, 3) | contained(s, 4):
                counts[p] = counts.get(p, 0) + 1
        out |= {(tr, p): n for p, n in counts.items() if n * 10 >= 6 * len(own)}
    return out


def _rows(seed, traces, threads, most):
    rng = random.Random(seed)
    rows, i = [], 0
    for tr in range(traces):
        ids = [rng.randrange(3, 12) for _ in range(5)]
        for th in range(threads):
            for t in range(rng.randrange(0, most)):
                i += 1
                rows.append((i, tr, th // 2, th % 2, rng.randrange(60), rng.choice([*ids, 6, 7, None]), "x", 1))
    return rows + rows[::7]


def test_patterns_against_brute_force(spark, split):
    for seed, size in ((1, (4, 5, 40)), (2, (1, 1, 300)), (3, (1, 3, 200)), (4, (30, 3, 9))):
        rows = _rows(seed, *size)
        got = {(r[0], r[1]): r[2] for r in frequent_subsequences(spark.createDataFrame(rows, BURSTS)).collect()}
        assert got == brute_patterns(rows)


def test_patterns_of_nulls_and_empty_tables(spark):
    rows = [(1, 1, None, 0, 1, 6, "", 1), (None, 1, 0, 0, 1, 6, "", 1), (2, 1, 0, 0, None, 6, "", 1), (3, 1, 0, 0, 3, None, "", 1), (4, 1, 0, 0, 4, 6, "", 1)]
    df = spark.createDataFrame(rows, BURSTS)
    assert frequent_subsequences(df).count() == 0
    assert frequent_subsequences(df.limit(0)).count() == 0


# ---------------------------------------------------------------- clusters

EVENTS = "instance long, trace_id long, task_id long, event_type long, event_value long"


def _groups(seed=0):
    """Planted groups, sparse noise, a group that noise invades, one too small, and one too wide."""
    rng = np.random.default_rng(seed)
    rows, events, want = [], [], {}
    n = 0

    def add(trace, values, group=None):
        nonlocal n
        n += 1
        rows.append((n, trace, 0, 0, n, 6, "", int(values[0])))
        events.extend((n, trace, 0, t, int(v)) for t, v in zip((42000050, 42000059), values[1:]))
        if group is not None:
            want.setdefault(group, []).append(n)

    for trace in (1, 2):
        for g, centre in enumerate(([1e5, 3e6, 1e6], [1e7, 3e6, 1e6], [1e5, 9e7, 5e7])):
            for _ in range(40):
                add(trace, np.array(centre) * np.exp(rng.uniform(-0.18, 0.18, 3)), (trace, g))
        for _ in range(25):
            add(trace, np.array([1e3, 1e3, 1e3]) * np.exp(rng.uniform(-0.1, 0.1, 3)))
        add(trace, np.array([1e3, 1e3, 1e3]) * 1.55)
        for _ in range(19):
            add(trace, [5e8, 5e8, 5e8])
        for _ in range(60):
            add(trace, np.array([1e10, 1e10, 1e10]) * np.exp(rng.uniform(-0.6, 0.6, 3)))
        for bad in ([0, 5, 5], [5, 0, 5], [-5, 5, 5]):
            add(trace, bad)
    rows.append((n + 1, 1, 0, 0, 1, 6, "", None))
    return rows + rows[:30], events + events[:50], {(i, min(v)) for v in want.values() for i in v}


def test_planted_groups(spark):
    rows, events, want = _groups()
    members, stats, isolated = C.clusters(spark.createDataFrame(rows, BURSTS), spark.createDataFrame(events, EVENTS))
    own = members.join(isolated.select("cluster", "first"), "cluster").select("instance", "first")
    assert {tuple(r) for r in own.collect()} == want
    assert members.count() == members.select("instance").distinct().count()
    assert stats.agg(F.sum("size")).first()[0] == members.count()
    top = C.typical(members, stats).toPandas()
    assert top.groupby("group_first")["rank"].max().max() == C.TYPICAL and not top.instance.duplicated().any()


def test_clusters_of_empty_tables(spark):
    b, e = spark.createDataFrame([], BURSTS), spark.createDataFrame([], EVENTS)
    assert [x.count() for x in C.clusters(b, e)] == [0, 0, 0]


def test_similarity_falls_with_distance():
    place = np.array([[100, 100, 100], [100, 100, 101], [101, 101, 101], [102, 102, 102], [103, 100, 100], [110, 100, 100]])
    t = C.token_sets(place)
    same = C.similarity(np.repeat(t[:1], len(t), 0), t)
    assert same == pytest.approx([1, 7 / 9, 7 / 9, 6 / 10, 5 / 11, 0])
    assert [s >= C.JACCARD for s in same] == [True, True, True, True, False, False]


def _cells(spark):
    import pyarrow as pa

    rows = C.with_cells(C.points(*[spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("bursts", "burst_events")]))
    cells = np.array(sorted(r[0] for r in rows.select("cell").distinct().collect()))
    out = pa.Table.from_batches(list(C._bands(iter([pa.RecordBatch.from_arrays([pa.array(cells)], ["cell"])])))).sort_by([("bucket", "ascending"), ("cell", "ascending")])
    return cells, out.column("bucket").to_numpy(), out.column("cell").to_numpy()


def test_bands_find_similar_records_and_jaccard_decides(spark, monkeypatch):
    """Recall of the banding over all similar pairs by brute force; without the threshold other records are joined."""
    cells, bucket, cell = _cells(spark)
    trace, place = C.unpack_cells(cells)
    tokens = C.token_sets(place)
    keys = {}
    for b, c in zip(bucket.tolist(), cell.tolist()):
        keys.setdefault(c, set()).add(b)
    found = total = 0
    for t in np.unique(trace):
        own = np.flatnonzero(trace == t)
        for i in own:
            later = own[own > i]
            near = later[C.similarity(np.repeat(tokens[i:i + 1], len(later), 0), tokens[later]) >= C.JACCARD]
            total += len(near)
            found += sum(bool(keys[cells[i]] & keys[cells[j]]) for j in near)
    assert total > 1000 and found >= 0.99 * total
    joined = dict(zip(*C._stars(bucket, cell)))
    monkeypatch.setattr(C, "JACCARD", 0.0)
    assert dict(zip(*C._stars(bucket, cell))) != joined


def test_pieces_of_buckets_give_the_same_stars(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    bucket = np.sort(rng.integers(0, 60, 900))
    cell = (1 << 27) | (rng.integers(50, 70, 900) << 18) | (rng.integers(50, 70, 900) << 9) | 50

    def roots():
        batches = [pa.RecordBatch.from_arrays([pa.array(bucket[i:i + 70]), pa.array(cell[i:i + 70])], ["bucket", "cell"]) for i in range(0, 900, 70)]
        pairs = pa.Table.from_batches(list(C._verified(iter(batches))))
        return C.smallest(pairs.column("a").to_numpy(), pairs.column("b").to_numpy())

    whole = roots()
    monkeypatch.setattr(C, "PIECE", 100)
    assert all((x == y).all() for x, y in zip(whole, roots()))


def test_trace_ids_of_any_size(spark):
    rows, events, want = _groups()
    big = {1: 1 << 62, 2: -5}
    bursts = spark.createDataFrame([(r[0], big[r[1]], *r[2:]) for r in rows], BURSTS)
    members, _, isolated = C.clusters(bursts, spark.createDataFrame(events, EVENTS))
    assert {tuple(r) for r in members.join(isolated.select("cluster", "first"), "cluster").select("instance", "first").collect()} == want


def test_split_of_a_loose_component():
    import pyarrow as pa

    cells = np.array([(1 << 27) | (x << 18) | (50 << 9) | 50 for x in range(40, 60)])
    out = C._split(pa.table({"root": cells * 0, "cell": cells, "rows": np.where(cells == cells[10], 100, 1)})).to_pandas()
    parts = out.groupby("cluster").cell.agg(["min", "max", "size"])
    assert parts["size"].sum() == 20 and ((parts["max"] - parts["min"]) // (1 << 18) <= 2 * int(np.log(C.NEAR) / C.STEP)).all()
    assert isinstance(out, pd.DataFrame)
