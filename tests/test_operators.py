"""Burst operators on hand-made cases and against simple sequential versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import metrics as M
from quillon.operators import assembly, centroid, compare, hulls, neighbors, normalize, refine, sequence_score, stats
from quillon.operators.components import components
from quillon.operators.dbscan import dbscan
from quillon.operators.ranks import neighbours, ranked
from quillon.plans.pipeline import Analysis
from quillon.sources import formats, sinks, trace_text

# ---------------------------------------------------------------- metrics


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 6, 0), (2, 6, 3), (3, None, 3), (4, 0, 2)], "id int, a long, b long")
    div = {r[0]: r[1] for r in rows.select("id", M.mixed(F.col("a"), F.col("b"), "/ratio")).collect()}
    assert div == {1: 0.0, 2: 2.0, 3: None, 4: 0.0}
    with pytest.raises(ValueError):
        M.mixed(F.col("a"), F.col("b"), "%")
    logs = {r[0]: r[1] for r in rows.select("id", M.log_metric(F.col("a"))).collect()}
    assert logs[4] == M.LOG_OF_ZERO and logs[2] == pytest.approx(np.log(6)) and logs[3] is None
    over = spark.createDataFrame([(42001226, 1 << 33 | 5), (42001219, 1 << 31), (7, 1 << 33)], "t long, v long")
    assert [r[0] for r in over.select(M.overflow_fixed(F.col("t"), F.col("v"))).collect()] == [5, (1 << 31) ^ 0xFFFFFFFF, 1 << 33]


def test_burst_type_precedence(spark):
    p = [M.Parameter("a", low=10), M.Parameter("b", high=5)]
    cases = [((None, 3, 9), 1), ((20, None, 9), 1), ((20, 9, 9), 3), ((None, 9, 9), 3), ((5, None, 9), 1), ((5, 3, 9), 3), ((20, 3, 1), 2), ((5, 3, 1), 2), ((None, 3, 1), 1), ((20, 3, 9), 0)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a long, b long, duration long")
    got = [r[0] for r in df.orderBy("i").select(M.burst_type(p, 5)).collect()]
    assert got == [w for _, w in cases]


def test_times():
    assert [M.nanoseconds(t) for t in ("5", "3s", "2ms", "7us", "4ns", "1H", "2D", "1M", "1.9s")] == [5000, 3 * 10**9, 2 * 10**6, 7000, 4, 3600 * 10**9, 2 * 86400 * 10**9, 60 * 10**9, 10**9]
    with pytest.raises(ValueError):
        M.nanoseconds("x")


def test_normal_distribution(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double").select(M.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.0249979, 0.5, 0.8413447], abs=2e-7)


# ---------------------------------------------------------------- normalisation, ranks, statistics


def test_normalisation_of_constants(spark):
    df = spark.createDataFrame([(0, 5, 1), (0, 5, 3), (1, 9, 9), (0, 5, None)], "burst_type int, a long, b long")
    got = [(r["n_a"], r["n_b"]) for r in normalize.range_normalize(df, ["a", "b"], 2.0).collect()]
    assert got == [(0.0, 0.0), (0.0, 2.0), (None, None), (0.0, None)]
    assert normalize.zscore(df, ["a"]).count() == 4 and normalize.range_normalize(df.limit(0), ["a"]).count() == 0


def test_ranks_and_sampling(spark, split):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "task_id int, instance long"), ["task_id"], ["instance"]).collect()
    for k in (1, 2, None):
        own = sorted((r["instance"], r["_rank"]) for r in got if r["task_id"] == k)
        assert [r for _, r in own] == list(range(1, len(own) + 1))
    df = spark.createDataFrame(rows, "task_id int, instance long")
    sample = normalize.stride_sample(df.dropna(), 100)
    assert 80 <= sample.count() <= 100 and sample.count() == sample.distinct().count()
    assert normalize.stride_sample(df, 5000).count() == 2000


def test_neighbouring_rows_over_cut_partitions(spark, split):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, None, 2]), t, i) for i, t in enumerate(rng.sample(range(10000), 1500))]
    got = {r["i"]: (r["_prev"] and r["_prev"]["i"], r["_next"] and r["_next"]["i"]) for r in neighbours(spark.createDataFrame(rows, "k int, t long, i int"), ["k"], ["t"], ["i"]).collect()}
    for k in (1, 2, None):
        own = [i for _, i in sorted((r[1], r[2]) for r in rows if r[0] == k)]
        assert [got[i] for i in own] == list(zip([None, *own], [*own[1:], None]))
    assert neighbours(spark.createDataFrame([], "k int, t long, i int"), ["k"], ["t"], ["i"]).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, 0, 5, None), (2, 6, 7, 1.0), (3, 6, 3, None), (4, 7, 10, 2.0), (5, None, None, None)], "instance long, cluster_id int, duration long, x double")
    s = stats.cluster_stats(df, metrics=["x"])
    assert s.agg(F.sum("share")).first()[0] == pytest.approx(1)
    got = {r["cluster_id"]: (r["ranked_id"], r["avg_x"]) for r in stats.rank_clusters(s).collect()}
    assert got == {0: (0, None), 6: (1, 1.0), 7: (2, 2.0)}
    far = {r["metric"]: (r["least_instance"], r["largest_instance"]) for r in stats.extremes(df, ["duration"]).collect()}
    assert far == {"duration": (3, 4)}


# ---------------------------------------------------------------- assembly


def test_table_of_all_clusters(spark):
    """Every ranked cluster and every statistic of K2, as its SQL has them."""
    import duckdb

    from quillon.plans import reference

    folder = "/root/testdata/sf0.001"
    got = {(r["statistic"], r["cluster"]): float("nan") if r["v"] is None else r["v"] for r in reference.clusters_info_all(spark, folder).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW bursts AS SELECT * FROM '{folder}/bursts.parquet'")
    want = {(s, c): float("nan") if v is None else float(v) for s, c, v in con.execute(reference.SQL["clusters_info_all"]).fetchall()}
    ids = reference.rank_clusters(spark, folder).count()
    assert got == pytest.approx(want, rel=1e-9, nan_ok=True) and len(got) == 6 * ids and ids > 4


def _log(spark, states, events):
    s = spark.createDataFrame(states, "task long, thread long, begin long, end long, line long, state int")
    e = spark.createDataFrame(events, "task long, thread long, ts long, line long, ordinal int, event_type long, event_value long")
    return e, s


def test_events_at_boundaries_and_in_gaps(spark):
    states = [(0, 0, 10, 20, 1, 1), (0, 0, 20, 30, 2, 1), (0, 0, 40, 50, 3, 1), (0, 0, 30, 40, 4, 0), (1, 0, 0, 5, 5, 1)]
    events = [(0, 0, t, 100 + t, 0, 7, 1) for t in (5, 10, 11, 20, 21, 30, 35, 40, 41, 50, 55)] + [(1, 0, 3, 9, 0, 7, 2), (2, 0, 3, 9, 0, 7, 2)]
    got = {(r["task"], r["ts"]): r["begin"] for r in assembly.burst_events(*_log(spark, states, events)).collect()}
    assert got == {(0, 11): 10, (0, 20): 10, (0, 21): 20, (0, 30): 20, (0, 41): 40, (0, 50): 40, (1, 3): 0}


def test_as_of_over_cut_partitions(spark, split):
    rng = random.Random(3)
    states = [(rng.choice([0, 0, 0, 1]), 0, t, t + 5, t, 1) for t in range(0, 3000, 7)]
    events = [(rng.choice([0, 0, 0, 1]), 0, rng.randrange(3000), i, 0, 7, 1) for i in range(2000)]
    got = {r["line"]: r["burst_line"] for r in assembly.as_of(*[x.withColumnRenamed("line", n) for x, n in zip(_log(spark, states, events), ("line", "burst_line"))], ["task", "thread"], payload=("begin", "burst_line"), tie="burst_line").collect()}
    for task, _, ts, line, *_ in events:
        assert got[line] == max((s[4] for s in states if s[0] == task and s[2] < ts), default=None)


def test_counter_set_changes(spark):
    states = [(0, 0, 0, 10, 1, 1), (0, 0, 10, 20, 2, 1)]
    events = [(0, 0, 10, 5, 0, 7, 1), (0, 0, 10, 5, 1, 41999999, 2), (0, 0, 10, 5, 2, 8, 3), (0, 0, 15, 6, 0, 41999999, 1), (0, 0, 18, 7, 0, 9, 1)]
    inside = assembly.burst_events(*_log(spark, states, events))
    assert {(r["ts"], r["event_type"]) for r in assembly.cut_counter_sets(inside).collect()} == {(10, 7), (15, 41999999), (18, 9)}
    assert {r["event_type"] for r in assembly.without_late_types(inside.where("begin = 10")).collect()} == {41999999}
    usable = M.usable_types(inside, ["task", "thread", "begin"]).collect()
    assert {(r["begin"], r["event_type"]) for r in usable} == {(0, 7), (0, 41999999), (0, 8), (10, 41999999), (10, 9)}


def test_regions(spark):
    e = spark.createDataFrame([(0, 0, t, t, 0, 5, v) for t, v in ((1, 2), (4, 0), (5, 0), (6, 3), (7, 4), (9, 0), (11, 6))], "task long, thread long, ts long, line long, ordinal int, event_type long, event_value long")
    regions, bad = assembly.event_regions(e, [5])
    assert {(r["begin"], r["end"]) for r in regions.collect()} == {(1, 4), (7, 9)}
    assert {r["ts"] for r in bad.collect()} == {5, 6, 11}
    assert {(r["begin"], r["end"]) for r in assembly.consecutive_regions(e, [5]).collect()} == {(1, 4), (4, 5), (5, 6), (6, 7), (7, 9), (9, 11)}


# ---------------------------------------------------------------- density


def sequential(x, eps, least):
    """The scan in row order: a new cluster takes all neighbours of its start, growth takes unassigned and noise points."""
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    label, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if label[i] != -1:
            continue
        if len(near[i]) < least:
            label[i] = 0
            continue
        number += 1
        label[near[i]] = number
        todo = [j for j in near[i] if j != i]
        while todo:
            j = todo.pop(0)
            if len(near[j]) >= least:
                for k in near[j]:
                    if label[k] in (-1, 0):
                        if label[k] == -1:
                            todo.append(k)
                        label[k] = number
    return label


def test_density_against_the_scan(spark):
    for seed in range(2):
        rng = np.random.default_rng(seed)
        x = np.round(rng.random((90, 2)) * (1 if seed % 2 else 0.6), 2)
        df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
        got = {r[0]: r[1] for r in dbscan(df, ["x", "y"], 0.08, 4).collect()}
        assert [got[i] for i in range(len(x))] == sequential(x, 0.08, 4).tolist(), seed


def test_density_of_dense_cells_and_near_misses(spark):
    """Full cells, clusters a little more than eps apart, chains over thin cells, in one to three dimensions."""
    for d in (1, 2, 3):
        rng = np.random.default_rng(d)
        centres = rng.random((6, d)) * 2
        x = np.concatenate([c + rng.normal(0, 0.06, (70, d)) for c in centres] + [centres[0] + np.outer(np.arange(1, 12), np.eye(d)[0]) * 0.049, centres[1] + rng.random((60, d)) * 0.5])
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"x{k} double" for k in range(d)))
        got = {r[0]: r[1] for r in dbscan(df, [f"x{k}" for k in range(d)], 0.05, 4).collect()}
        assert [got[i] for i in range(len(x))] == sequential(x, 0.05, 4).tolist(), d
    wide = [(i, a, b) for i, (a, b) in enumerate((u + s * 0.06, v) for s in (0, 1) for u in np.linspace(0, 0.02, 12) for v in np.linspace(0, 0.4, 60))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, a, b in wide], "id long, x double, y double")
    for eps in (0.039, 0.041):
        got = {r[0]: r[1] for r in dbscan(df, ["x", "y"], eps, 5).collect()}
        assert len(set(got.values())) == (2 if eps < 0.04 else 1)


def test_bursts_are_clustered_by_their_own_values(spark, tmp_path):
    """Ratios of 0.0151 and 0.0449 lie further apart than eps, though not if they are rounded to 0.02 and 0.04."""
    from quillon.plans import reference

    ids = spark.range(20).withColumnRenamed("id", "instance")
    b = F.when(F.col("instance") < 10, round(10**9 / 0.0151)).otherwise(round(10**9 / 0.0449))
    events = ids.select("instance", F.lit(42000050).cast("long").alias("event_type"), F.lit(10**9).cast("long").alias("event_value"))
    events.unionByName(ids.select("instance", F.lit(42000059).cast("long").alias("event_type"), b.cast("long").alias("event_value"))).write.parquet(str(tmp_path / "burst_events.parquet"))
    ids.withColumns({c: F.lit(0) for c in reference.COLUMNS}).write.parquet(str(tmp_path / "bursts.parquet"))
    got = [r["cluster_id"] for r in reference.dbscan_bursts(spark, str(tmp_path)).collect()]
    assert got == [0] * 20


def test_density_of_copies_nulls_and_empty(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(50)] + [(90, 5.0, 5.0), (91, None, 1.0)], "id long, x double, y double")
    got = {r[0]: r[1] for r in dbscan(df, ["x", "y"], 0.1, 5).collect()}
    assert {got[i] for i in range(50)} == {1} and got[90] == got[91] == 0 and len(got) == 52
    assert dbscan(df.limit(0), ["x", "y"], 0.1, 5).count() == 0
    assert {r[1] for r in dbscan(df.where("id > 80"), ["x", "y"], 0.1, 1).collect()} == {1, 0}


def test_components(spark, split, monkeypatch):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)] + [(900, 900), (5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    assert got == {i: find(i) for i in list(root)}
    monkeypatch.setattr("quillon.operators.components.ONE_TASK", 3)
    assert {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_rows_of_many_copies(spark, tmp_path):
    """More copies of a point than a list holds, null ids and null coordinates; no side goes to the driver."""
    import __spark_entry__

    rng = random.Random(5)
    rows = [(i, 10, 950.0) for i in range(300)] + [(1000 + i, rng.randint(9, 11), 900 + rng.randint(0, 900) / 10) for i in range(200)] + [(None, 10, 951.0), (5000, None, 950.0), (5001, 10, None)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["eps_pairs"](spark, str(tmp_path))
    points = [(i, s / 50.0, (p - 900.0) / 1200.0) for i, s, p in rows if s is not None and p is not None]
    want = Counter((a, b) for a, x, y in points for b, v, w in points if (x - v) * (x - v) + (y - w) * (y - w) <= 0.012 * 0.012)
    assert Counter((r["id"], r["other"]) for r in df.collect()) == want and want[(0, 299)] == want[(None, 0)] == 1
    assert "BroadcastHashJoin" not in _plan(df)


def test_nearest_samples_of_many_copies(spark, tmp_path):
    """All copies of a point take the label of one nearest sample, and no side goes to the driver."""
    import __spark_entry__

    rng = random.Random(6)
    rows = [(i, 10, 950.0) for i in range(300)] + [(1000 + i, rng.randint(5, 15), 900 + rng.randint(0, 900) / 10) for i in range(200)] + [(None, 10, 951.0), (5000, None, 950.0), (5001, 10, None), (5002, 40, 950.0)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["nn_classify"](spark, str(tmp_path))
    points = [(i, s / 50.0, (p - 900.0) / 1200.0) for i, s, p in rows if s is not None and p is not None and i is not None]
    want = {i: 0 for i, *_ in rows}
    for a, x, y in points:
        near = [(d2, b) for b, v, w in points if b % 5 == 0 and (d2 := (x - v) * (x - v) + (y - w) * (y - w)) < 0.012 * 0.012]
        want[a] = min(near)[1] % 7 + 1 if near else 0
    assert Counter((r["id"], r["cluster_id"]) for r in df.collect()) == Counter(want.items()) and want[299] == 1 and want[5002] == 0
    assert "BroadcastHashJoin" not in _plan(df)


def test_nearest_and_k_distances(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((120, 2)), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    near = {(r["id"], r["rank"]): r["other"] for r in neighbors.k_nearest(df, df, ["x", "y"], 3).collect()}
    for i in range(len(x)):
        assert [near[i, k] for k in (1, 2, 3)] == sorted(range(len(x)), key=lambda j: (d2[i, j], j))[:3]
    for d in (1, 2, 3):  # uneven density, copies, queries that are no points and lie outside
        p = np.concatenate([rng.random((150, d)) * 0.01, rng.random((40, d)) * 5, np.repeat(rng.random((1, d)), 30, 0)])
        q = np.concatenate([rng.random((20, d)) * 8 - 2, p[::9]])
        names = [f"x{i}" for i in range(d)]
        frame = lambda rows: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))
        got = {(r["id"], r["rank"]): r["other"] for r in neighbors.k_nearest(frame(q), frame(p), names, 6).collect()}
        far = sum((q[:, None, i] - p[None, :, i]) ** 2 for i in range(d))
        for i in range(len(q)):
            assert [got[i, k] for k in range(1, 7)] == np.lexsort((np.arange(len(p)), far[i]))[:6].tolist()
    kd = {(r["k"], r["id"]): r["dist"] for r in neighbors.k_distances(df, ["x", "y"], 2, 3).collect()}
    assert kd[3, 0] == pytest.approx(np.sqrt(np.sort(d2[0])[3])) and len(kd) == 240
    assert neighbors.k_nearest(df, df.limit(0), ["x", "y"], 3).count() == 0
    eps = [r["eps"] for r in neighbors.auto_epsilon(neighbors.k_distances(df, ["x", "y"], 4, 4)).orderBy("step").collect()]
    assert len(eps) >= 1 and eps == sorted(eps, reverse=True)


# ---------------------------------------------------------------- comparison, sequences, hulls, centroids


def test_mirkin(spark):
    make = lambda ids: spark.createDataFrame(list(enumerate(ids)), "instance long, cluster_id int")
    value = lambda a, b, **k: compare.mirkin(make(a), make(b), **k).first()[0]
    assert value([1, 1, 2, 2], [5, 5, 9, 9]) == 0
    assert value([1, 1, 2, 2], [1, 2, 3, 4]) == value([1, 2, 3, 4], [1, 1, 2, 2]) == (8 + 4 - 8) / 16
    assert value([0, 1, 1], [0, 1, 2], noise=0) == (4 + 2 - 4) / 4


def test_alignment_and_scores(spark):
    same = sequence_score.align([[1, 2, 3]] * 3, {1: 0.5, 2: 0.3, 3: 0.2})
    assert same.tolist() == [[1, 2, 3]] * 3
    one = sequence_score.align([[1, 2, 3, 2], [1, 3, 2]], {1: 0.5, 2: 0.3, 3: 0.2})
    assert one.tolist() == [[1, 2, 3, 2], [1, -1, 3, 2]]
    rows = [(1, 0, th, i, c, 10) for th in range(4) for i, c in enumerate([1, 2, 3, 2] if th else [1, 3, 2])]
    df = spark.createDataFrame(rows, "trace_id long, task_id long, thread_id long, instance long, cluster_id int, duration long")
    weights = spark.createDataFrame([(1, 1, 0.3), (1, 2, 0.4), (1, 3, 0.3)], "trace_id long, cluster_id int, weight double")
    aligned = sequence_score.aligned_sequences(df, weights)
    got = {r["cluster_id"]: r["score"] for r in sequence_score.score_by_cluster(aligned, weights.drop("trace_id"), 4).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.875, 3: 1.0})
    lines = {r["thread_id"]: r["sequence"] for r in sequence_score.sequence_lines(aligned).collect()}
    assert lines[0] == "1,-,3,2" and lines[1] == "1,2,3,2"


def test_whole_sequences_are_aligned(spark, tmp_path):
    """A thread that lacks the first 30 of 100 bursts is shifted as a whole: columns of both threads for its 70, of one for 30."""
    from quillon.plans import reference

    ids = [6 + p * p % 11 * (p % 7 + 1) % 23 for p in range(100)]
    rows = [(th * 1000 + i, 1, 0, th, c, 10) for th in range(2) for i, c in enumerate(ids) if not th or i >= 30]
    own = spark.createDataFrame(rows, "instance long, trace_id long, task_id long, thread_id long, cluster_id int, duration long")
    own.withColumns({c: F.lit(0) for c in reference.COLUMNS if c not in own.columns}).write.parquet(str(tmp_path / "bursts.parquet"))
    got = {r["cluster_id"]: (r["score"], r["occurrences"]) for r in reference.aligned_scores(spark, str(tmp_path)).collect()}
    for c in set(ids):
        first, rest = ids[:30].count(c), ids[30:].count(c)
        assert got[c] == (pytest.approx((first / 2 + rest) / (first + rest), abs=1e-6), first + 2 * rest)


def test_columns_of_several_windows_stay_apart(spark):
    """A thread of 600 bursts: no share of threads above 1, neither over whole sequences nor over windows."""
    own = spark.createDataFrame([(1, 0, th, i, 1 + (i >= 512), 10) for th in range(2) for i in range(600)], "trace_id long, task_id long, thread_id long, instance long, cluster_id int, duration long")
    weights = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.1)], "trace_id long, cluster_id int, weight double")
    for most, windows in ((None, 1), (512, 2), (300, 2)):
        aligned = sequence_score.aligned_sequences(own, weights, most=most).cache()
        assert aligned.select("window").distinct().count() == windows
        got = {r["cluster_id"]: (r["score"], r["occurrences"]) for r in sequence_score.score_by_cluster(aligned, weights.drop("trace_id"), 2).collect()}
        assert got == {1: (1.0, 1024), 2: (1.0, 176)}
        assert {r["sequence"] for r in sequence_score.sequence_lines(aligned).collect()} == {",".join(["1"] * 512 + ["2"] * 88)}
        assert sequence_score.identical_columns(aligned).count() == 0


def test_hulls(spark):
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5], [0.5, 0]], float)
    assert sorted(hulls.hull(square).tolist()) == [0, 1, 2, 3]
    assert len(hulls.hull(square[:1])) == 1 and len(hulls.hull(square[:2])) == 2
    far = square + [5, 0]
    assert hulls.overlap(square[:4], square[:4] + [1, 0]) and not hulls.overlap(square[:4], far[:4])
    merged = hulls.merge([{"points": square[:4], "density": 4, "total_time": 1}, {"points": square[:4] + [0.5, 0], "density": 4, "total_time": 2}, {"points": far[:4], "density": 4, "total_time": 4}])
    assert sorted(m["density"] for m in merged) == [4, 8]
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3), float(x + 3 * (i % 3)), float(y), 1) for i, (x, y) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame([*rows, (999, 1, None, 1.0, 1)], "instance long, cluster_id int, x double, y double, duration long")
    model = hulls.hulls(df, "x", "y")
    found = {r[0]: r[1] for r in hulls.classify(df, model, "x", "y").collect()}
    assert all(found[i] == c for i, c, *_ in rows if c > 0) and found[999] == 0
    old, hulls.SHIPPED_CORNERS = hulls.SHIPPED_CORNERS, 0
    try:
        assert {r[0]: r[1] for r in hulls.classify(df, model, "x", "y").collect()} == found
    finally:
        hulls.SHIPPED_CORNERS = old


def test_hull_of_many_points_and_copies():
    rng = np.random.default_rng(9)
    for points in (rng.normal(size=(3000, 2)), np.round(rng.random((2000, 2)), 1), np.stack([np.arange(200.0), np.arange(200.0)], 1)):
        at = points[hulls._kept(points, np.arange(len(points)))]
        edge = np.roll(at, -1, axis=0) - at
        side = edge[:, None, 0] * (points[None, :, 1] - at[:, None, 1]) - edge[:, None, 1] * (points[None, :, 0] - at[:, None, 0])
        assert (side >= -1e-9).all() and len(at) < 60


def test_points_near_hulls(spark, monkeypatch):
    """Outside all hulls the nearest corner decides, if it is near and dense enough."""
    rows = [(i, 1 + i // 4, *xy, 1, 5 if i < 4 else 0) for i, xy in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.0, 1.0)])]
    model = hulls.hulls(spark.createDataFrame(rows, "instance long, cluster_id int, x double, y double, duration long, near long"), "x", "y", near="near")
    asked = spark.createDataFrame([(1, 0.5, 0.5, 0), (2, 1.1, 0.0, 0), (3, 1.9, 0.0, 0), (4, 1.9, 0.0, 5), (5, 1.5, 0.0, 9), (6, None, 0.0, 9)], "instance long, x double, y double, near long")
    for corners in (hulls.SHIPPED_CORNERS, 0):
        monkeypatch.setattr(hulls, "SHIPPED_CORNERS", corners)
        assert {r[0]: r[1] for r in hulls.classify(asked, model, "x", "y", eps=0.2, min_points=6, near="near").collect()} == {1: 1, 2: 1, 3: 0, 4: 2, 5: 0, 6: 0}
    near = lambda n: [{"points": [[k, 0.0], [k + 1, 0.0], [k + 0.5, 1.0]], "near": [n] * 3, "density": 3, "total_time": 1} for k in (0, 1.1)]
    assert [len(hulls.merge(near(n), 0.2, 8)) for n in (5, 4)] == [1, 2] and len(hulls.merge(near(5))) == 2


def test_tree_of_backends(spark):
    """Clusters spread over four backends, one of them too thin in each, come out as of all points at once."""
    rng = np.random.default_rng(4)
    rows = []
    for c, (x, y, n) in enumerate([(0, 0, 200), (3, 0, 120), (0, 3, 14)]):
        rows += [(len(rows) + i, float(x + a), float(y + b), i % 4, 10, c) for i, (a, b) in enumerate(rng.random((n, 2)) * 0.4)]
    rows.append((5000, 9.0, 9.0, 0, 10, -1))
    df = spark.createDataFrame(rows, "instance long, x double, y double, backend int, duration long, truth int")
    model, found = hulls.tree_clustering(df, "x", "y", "backend", 0.35, 8)
    assert [r["density"] for r in model.orderBy("cluster_id").collect()] == [200, 120, 14]
    got = {r[0]: r[1] for r in found.collect()}
    assert all(got[i] == t + 1 for i, *_, t in rows)


def test_centroids(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (80, 2)) for c in ((0, 0), (1, 1), (0, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.permutation(x))], "id long, x double, y double")
    labels = centroid.gmeans(df, ["x", "y"], 4.0, 8)
    assert 3 <= labels.select("cluster_id").distinct().count() <= 4 and labels.count() == 240
    medoids, own = centroid.clara(df, ["x", "y"], 3)
    assert len(medoids) == 3 and sorted(own.groupBy("cluster_id").count().toPandas()["count"]) == [80, 80, 80]
    test = {r[0]: r[2] for r in centroid.anderson_darling(spark.createDataFrame([(0, float(v)) for v in rng.normal(size=400)] + [(1, float(v)) for v in rng.exponential(size=400)] + [(2, 1.0)], "g int, v double"), "g", "v").collect()}
    assert test[0] < 1.1 < test[1] and test[2] is None


def test_refinement(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.02, (30, 2)) for c in ((0, 0), (0.3, 0), (3, 3))])
    df = spark.createDataFrame([(i, 10, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, duration long, x double, y double")
    score = lambda labels: {r[0]: (0.9, r[1]) for r in labels.where("cluster_id > 0").groupBy("cluster_id").count().collect()}
    labels, nodes = refine.refine_divisive(df, ["x", "y"], [0.6, 0.1], 4, score)
    assert labels.where("cluster_id > 0").select("cluster_id").distinct().count() == 3 and {n.level for n in nodes} == {0, 1}
    labels, nodes = refine.refine_aggregative(df, ["x", "y"], refine.eps_ladder(0.1, 0.6, 2), 4, score)
    assert labels.select("cluster_id").distinct().count() == 2
    tree = [refine.Node(1, 0), refine.Node(2, 1, parents=[1]), refine.Node(3, 2, parents=[2]), refine.Node(4, 2, parents=[2])]
    assert [(n.id, n.parents) for n in refine.collapse(tree)] == [(1, []), (3, [1]), (4, [1])]
    assert "->" in sinks.tree_dot(tree)
    noise = spark.createDataFrame([(i, 0 if i < 5 else 7) for i in range(90)], "id long, cluster_id int")
    assert refine.reclassify_noise(df, noise, ["x", "y"]).where("cluster_id = 0").count() == 0


def test_refinement_merges_clusters_of_the_same_columns(spark):
    """Two threads run one phase at values far apart: two clusters at every eps, one after the merge; noise stays out."""
    run = Analysis.__new__(Analysis)
    run.dims = ["n_x"]
    rows = [(2 * i + th, 0, th, 10, 0, (5.0 if i % 2 else th * 1.0) + 0.001 * i) for th in range(2) for i in range(20)]
    df = spark.createDataFrame(rows, "instance long, task_id long, thread_id long, duration long, burst_type int, n_x double")
    labels, nodes = run.refine(df, [0.1, 0.2], 4)
    got = {r["id"]: r["cluster_id"] for r in labels.collect()}
    assert {n.id for n in nodes} == {1, 2, 3} and len(got) == 40
    assert len({got[2 * i + th] for th in range(2) for i in range(0, 20, 2)}) == 1 and len(set(got.values())) == 2


# ---------------------------------------------------------------- text


LOG = ["#Trace (01/01/2020 at 10:00):1000_ns:1(2):1:2(1:1,1:1)", "c:1:1:2:1:2", "#d:Cutter:app:t:5:10:20", "1:1:1:1:1:0:10:1", "2:1:1:1:1:5:7:3:8:4", "2:1:1:2:1:6:7", "3:1:1:1:1:1:2:1:1:2:1:3:4:100:5", "4:1:1:2:1:9:1:10:20:3:0", "1:1:1:x:1:0:10:1"]


def test_text_log(spark):
    lines = spark.createDataFrame(list(enumerate(LOG, 1)), "line long, value string")
    recs = trace_text.records(lines)
    assert [tuple(r) for r in trace_text.events(recs).select("task", "ts", "ordinal", "event_type", "event_value").collect()] == [(0, 5, 0, 7, 3), (0, 5, 1, 8, 4)]
    assert trace_text.states(trace_text.records(lines, [1], [0])).count() == 1
    assert {r["line"] for r in trace_text.malformed(recs).collect()} == {6, 9}
    assert trace_text.communications(recs).first()["tag"] == 5 and trace_text.global_operations(recs).first()["op_id"] == 3
    assert trace_text.communicators(lines).first()["tasks"] == [0, 1] and trace_text.metadata(lines).first()["offset"] == 5
    head = trace_text.header(LOG[0])
    assert (head.final_time, head.time_factor, head.applications) == (1000, 1, [[(1, 1), (1, 1)]])
    assert [formats.sniff(x) for x in ("#Trace (", "SDDFA;;", "# Instance", "x")] == ["trace", "simulator", "bursts", "unknown"]


def test_simulator_records_and_labels(spark):
    text = ['"CPU burst" { 0, 0, 0.5 };;', '"user event" { 0, 0, 7, 3 };;', '"user event" { 0, 0, 7, 9 };;', '"send" { 0, 0, 1 };;', '"block begin" { 0, 0, 2 };;', '"CPU burst" { 0, 0, 1 };;', '"block end" { 0, 0, 2 };;', '"CPU burst" { 0, 0, 1e-9 };;']
    got = formats.simulator_bursts(spark.createDataFrame(list(enumerate(text)), "line long, value string")).orderBy("line").collect()
    assert [(r["line"], r["duration"], r["counters"]) for r in got] == [(0, 5 * 10**8, {7: 3}), (7, 1, None)]
    pcf = ["STATES", "0 Idle", "1 Running", "", "EVENT_TYPE", "9 42000050 (A) Instr", "9 42000059 (B) Cycles", "VALUES", "0 End", "1 Begin", ""]
    rows = formats.labels(spark.createDataFrame(list(enumerate(pcf)), "line long, value string")).collect()
    assert sum(r["kind"] == "state" for r in rows) == 2 and sum(r["kind"] == "type" for r in rows) == 2 and sum(r["kind"] == "value" for r in rows) == 4


XML = """<clustering_definition use_duration="no" apply_log="yes" normalize_data="yes" duration_filter="10" threshold_filter="0">
<clustering_algorithm name="DBSCAN"><epsilon>0.1</epsilon><min_points>3</min_points></clustering_algorithm>
<clustering_parameters><single_event apply_log="yes" name="INS"><event_type>42000050</event_type><range_min>1</range_min></single_event>
<mixed_events apply_log="no" name="IPC" operation="/"><event_type_a>42000050</event_type_a><event_type_b>42000059</event_type_b></mixed_events></clustering_parameters>
<extrapolation_parameters all_counters="yes"/><output_plots all_plots="no"><plot_definition raw_metrics="yes"><x_metric>IPC</x_metric><y_metric>INS</y_metric></plot_definition></output_plots></clustering_definition>"""


def test_definitions():
    d = config.parse(XML)
    assert (d.algorithm, d.arguments, d.duration_filter, d.all_counters) == ("DBSCAN", {"epsilon": "0.1", "min_points": "3"}, 10_000, True)
    assert [(m.name, m.low, m.log, m.operation) for m in d.clustering] == [("INS", 1.0, True, ""), ("IPC", None, False, "/")]
    assert d.plots[0].raw and not d.all_plots
    for bad in (XML.replace("output_plots", "plots"), XML.replace('name="IPC"', 'name="INS"'), XML.replace('operation="/"', 'operation="?"')):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert "plot" in sinks.plot_script("f.csv", "a", "b", [0, 1], ["a", "b", "cluster_id"]) and len(sinks.all_plots(["a", "b", "c"], ["x"])) == 9


def test_whole_analysis(spark):
    rng = np.random.default_rng(6)
    lines, n = [], 0
    for task in (1, 2):
        t = 0
        for k in range(40):
            size = [1000, 50000][k % 2] * (1 + 0.02 * rng.random())
            end = t + 20000 + int(size)
            lines += [f"1:1:1:{task}:1:{t}:{end}:1", f"2:1:1:{task}:1:{end}:42000050:{int(size)}:42000059:{2 * int(size)}"]
            t = end + 10
    own = spark.createDataFrame([(i, v) for i, v in enumerate(lines, 2)], "line long, value string")
    run = Analysis(config.parse(XML))
    bursts = run.prepare(run.extract(own))
    assert bursts.where("burst_type = 0").count() == 80
    found = run.cluster(bursts)
    assert sorted(r[0] for r in found.groupBy("cluster_id").count().select("count").collect()) == [40, 40]
    assert found.where("cluster_id = 1").agg(F.min("INS")).first()[0] > 10000
    score = {r["cluster_id"]: r["score"] for r in run.score(found).collect()}
    assert score == pytest.approx({1: 1.0, 2: 1.0})
    assert run.annotate(own, found).count() > own.count() and run.hull_model(found).count() == 2 and run.kdist(bursts, 2, 2).count() == 80
    assert run.stats(found).count() == 2
    sampled = run.cluster(bursts, most=40)
    assert sampled.where("cluster_id > 0").count() == 80


def test_definition_of_logs_ranges_and_means_on_a_log_in_microseconds(spark):
    """Hand-worked: the root's apply_log is the duration's alone, times are scaled once, counters are extrapolated, labels stand for event types."""
    text = '''<clustering_definition use_duration="no" apply_log="yes" normalize_data="yes" duration_filter="1000" threshold_filter="0">
      <clustering_algorithm name="DBSCAN"><epsilon>.3</epsilon><min_points>1</min_points></clustering_algorithm>
      <clustering_parameters>
        <single_event apply_log="yes" name="INS"><event_type>PAPI_TOT_INS</event_type><range_min>3e8</range_min><factor>1.0</factor></single_event>
        <mixed_events apply_log="no" name="IPC" operation="/"><event_type_a>PAPI_TOT_INS</event_type_a><event_type_b>42000059</event_type_b><factor>1.0</factor></mixed_events>
      </clustering_parameters>
      <extrapolation_parameters all_counters="yes"/></clustering_definition>'''
    labels = spark.createDataFrame([(42000050, "(PAPI_TOT_INS) Instr completed"), (42000059, "(PAPI_TOT_CYC) Cycles"), (42000000, "PAPI_L1_DCM [Misses]"), (90, "else")], "event_type long, label string")
    rows = [(0, 2000, 4e8, 8e8, 10), (3000, 6000, 1e9, 1.25e9, 20), (7000, 9500, 3e9, 3e9, 60), (10000, 12000, 1e8, 1e8, 5), (13000, 13500, 5e8, 5e8, 7)]
    lines = ["#Log (01/01/2020 at 10:00):20000:1(2):1:1(1:1)"]
    for begin, end, ins, cyc, misses in rows:
        lines += [f"1:1:1:1:1:{begin}:{end}:1", f"2:1:1:1:1:{end}:42000050:{int(ins)}:42000059:{int(cyc)}:42000000:{misses}"]
    run = Analysis(config.parse(text))
    bursts = run.prepare(run.extract(spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string")), labels)
    got = {r["begin_time"]: r for r in bursts.collect()}
    assert {b // 1000: (r["duration"], r["burst_type"]) for b, r in got.items()} == {
        0: (2_000_000, 0), 3000: (3_000_000, 0), 7000: (2_500_000, 0), 10000: (2_000_000, 3), 13000: (500_000, 2)}
    assert [got[b * 1000]["n_IPC"] for b in (0, 3000, 7000)] == pytest.approx([0, 0.6, 1])
    assert [got[b * 1000]["n_INS"] for b in (0, 3000, 7000)] == pytest.approx([0, np.log(2.5) / np.log(7.5), 1])
    assert got[0]["x_PAPI_L1_DCM"] == 10 and [m.name for m in run.extrapolated] == ["PAPI_L1_DCM", "PAPI_TOT_INS", "PAPI_TOT_CYC"]
    stats = run.stats(bursts.withColumn("cluster_id", F.lit(1))).first()
    assert stats["avg_x_PAPI_L1_DCM"] == pytest.approx(30) and stats["avg_IPC"] == pytest.approx((0.5 + 0.8 + 1) / 3)
    plain = Analysis(config.parse(text.replace('normalize_data="yes"', 'normalize_data="no"').replace('use_duration="no"', 'use_duration="yes"')))
    one = plain.prepare(bursts.select("instance", "task_id", "thread_id", "begin_time", "end_time", "duration", "line", "counters"), labels).where("begin_time = 0").first()
    assert (one["n_INS"], one["n_IPC"], one["n_Duration"]) == pytest.approx((np.log(4e8), 0.5, np.log(2e6)))
    with pytest.raises(config.ConfigError):
        Analysis(config.parse(text)).prepare(bursts.select("duration", "counters"))
    plain.definition.use_semantic = True
    assert [m.name for m in plain.metrics] == ["Semantic_Value", "Duration", "INS", "IPC"]


def test_command_line(spark, tmp_path, capsys):
    from quillon import cli

    lines = ["#Log (01/01/2020 at 10:00):900000_ns:1(2):1:2(1:1,1:1)"]
    for task in (1, 2):
        t = 0
        for k in range(12):
            size = [2000, 50000][k % 2] + 10 * k
            end = t + 20000 + size
            lines += [f"1:1:1:{task}:1:{t}:{end}:1", f"2:1:1:{task}:1:{end}:42000050:{size}:42000059:{2 * size}"]
            t = end + 10
    (tmp_path / "log").write_text("\n".join(lines))
    (tmp_path / "definition.xml").write_text(XML)
    (tmp_path / "labels").write_text("EVENT_TYPE\n9    42000050    (PAPI_TOT_INS) Instructions\n9    42000059    (PAPI_TOT_CYC) Cycles\n")
    of = lambda *a: [str(tmp_path / x[1:]) if x.startswith("@") else x for x in a]
    assert cli.main(of("cluster", "-i", "@log", "-d", "@definition.xml", "-l", "@labels", "-o", "@out", "-s", "--annotate"), spark) == 0
    rows = [r.value for r in spark.read.text(str(tmp_path / "out/bursts")).collect()]
    assert len(rows) == 25 and rows[0].startswith("# Instance,TaskId") and rows[0].endswith("x_PAPI_TOT_CYC,ClusterID")
    assert sorted({r.split(",")[-1] for r in rows[1:]}) == ["6", "7"]
    info = {(r["statistic"], r["cluster"]): float(r["v"]) for r in spark.read.option("header", True).csv(str(tmp_path / "out/clusters_info")).collect()}
    assert info["density", "Cluster 1"] == 12 and info["avg_x_PAPI_TOT_CYC", "Cluster 1"] == pytest.approx(2 * (50000 + 60))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/scores")).where("cluster = 'GLOBAL'").count() == 1
    assert spark.read.text(str(tmp_path / "out/log")).where("value like '%90000001%'").count() == 48
    cli.main(of("kdist", "-i", "@log", "-d", "@definition.xml", "-l", "@labels", "-o", "@out", "-k", "2,3"), spark)
    assert spark.read.text(str(tmp_path / "out/kdist")).count() == 48
    cli.main(of("score", "-i", "@out/bursts", "-o", "@scored"), spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "scored/scores")).count() == 3
    capsys.readouterr()
    cli.main(of("diff", "-1", "@out/bursts", "-2", "@out/bursts"), spark)
    assert float(capsys.readouterr().out) == 0.0
    (tmp_path / "records").write_text("SDDFA;;\n" + "\n".join(f'"CPU burst" {{ 0, 0, 0.0{k + 1} }};;\n"user event" {{ 0, 0, 42000050, {k + 5} }};;\n"user event" {{ 0, 0, 42000059, 7 }};;' for k in range(4)))
    cli.main(of("extract", "-i", "@records", "-d", "@definition.xml", "-o", "@plain"), spark)
    assert spark.read.text(str(tmp_path / "plain/bursts")).count() == 5


def test_annotated_events_by_line(spark):
    lines = spark.createDataFrame([(1, "#head"), (2, "2:1:1:1:1:10:5:1"), (3, "2:1:1:1:1:15:8:3"), (4, "2:1:1:1:1:20:5:2"), (5, "2:1:1:1:1:30:7:7")], "line long, value string")
    bursts = spark.createDataFrame([(2, 0, 0, 10, 20, 1), (4, 0, 0, 20, 28, 2)], "line long, task_id long, thread_id long, begin_time long, end_time long, cluster_id int")
    got = [r["value"] for r in sinks.annotated_events(lines, bursts).orderBy("line", "part").collect()]
    assert got == ["#head", "2:1:1:1:1:10:5:1", "2:1:1:1:1:10:90000001:6", "2:1:1:1:1:15:8:3", "2:1:1:1:1:20:5:2", "2:1:1:1:1:20:90000001:0:90000001:7", "2:0:1:1:1:28:90000001:0", "2:1:1:1:1:30:7:7"]


def test_medoids_of_all_points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(0, 0.05, (60, 2)) for c in ([0, 0], [1, 0], [0, 1])] + [[[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(999, None, 1.0)], "id long, x double, y double")
    centres, own = centroid.best_medoids(df.where("id < 180 or id > 900"), ["x", "y"], 5)
    labels = {r[0]: r[1] for r in own.collect()}
    assert len(centres) == 3 and labels[999] == 0 and all(len({labels[i] for i in range(s, s + 60)}) == 1 for s in (0, 60, 120))
    _, four = centroid.medoids(df, ["x", "y"], 4)
    assert {r[0]: r[1] for r in four.collect()}[180] not in {r[1] for r in four.where("id < 180").collect()}


def test_streamed_assembly_equals_batch(spark, tmp_path):
    from quillon.streaming import bursts as S

    rng = random.Random(7)
    rows, line = [], 0
    for task in (0, 1, 2):
        for t in range(0, 400, 20):
            line += 1
            rows.append((task, 0, "state", t, t + 15, line, None, None))
            for _ in range(3):
                line += 1
                rows.append((task, 0, "event", rng.randrange(400), None, line, rng.choice([7, 8]), rng.randrange(9)))
    df = spark.createDataFrame(rows, S.RECORDS)
    df.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = S.assemble(stream).writeStream.format("memory").queryName("assembled").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    import time

    # the last burst of a thread comes by its timeout, so batches never end by themselves
    for _ in range(60):
        time.sleep(1)
        if spark.sql("select distinct task from assembled where begin = 380").count() == 3:
            break
    query.stop()
    got = {tuple(r) for r in spark.sql("select task, begin, event_type, total from assembled where event_type is not null").collect()}
    states = df.where("kind = 'state'").select("task", "thread", F.col("ts").alias("begin"), "end", "line", F.lit(1).alias("state"))
    events = df.where("kind = 'event'").select("task", "thread", "ts", "line", "event_type", "event_value")
    want = {tuple(r) for r in assembly.sums(assembly.burst_events(events, states)).select("task", "begin", "event_type", "total").collect()}
    assert got == want
