"""Skew-proof results per key, broken lines and implausible measurements."""

import pickle
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import parsing, skew, spikes

DATA = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- 1


def _keyed(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, begin_time long, instance long, duration long, d_ipc double, row_count string")


def test_stats_of_a_heavy_key_nulls_and_repeated_rows(spark, split):
    rng = random.Random(1)
    rows = [(6, rng.randrange(50), i, rng.choice([None, 5, 7]), rng.choice([None, 1.5]), "x") for i in range(3000)]
    rows += [(rng.randrange(7, 30), i, i, i, 0.5, "x") for i in range(500)] + [(None, 1, 1, 1, 1.0, "x")] * 40 + [(99, None, None, None, None, None)] * 3
    df = _keyed(spark, rows)
    got = {r[0]: r[1:] for r in skew.skewed_stats(df, "cluster_id", ["begin_time", "instance"], {"n": F.count(F.lit(1)), "d": F.sum("duration"), "m": F.avg("d_ipc")}).collect()}
    pdf = pd.DataFrame(rows, columns=df.columns)
    for key, own in pdf.groupby("cluster_id", dropna=False):
        n, d, m = got[None if pd.isna(key) else int(key)]
        assert n == len(own) and d == (None if own.duration.isna().all() else own.duration.sum())
        assert (m is None) == own.d_ipc.isna().all() and (m is None or m == pytest.approx(own.d_ipc.mean()))
    assert len(got) == pdf.cluster_id.nunique(dropna=False)


def test_a_heavy_key_fills_several_partitions(spark, split):
    df = _keyed(spark, [(6, i, i, 1, 1.0, "") for i in range(5000)] + [(k, 0, 0, 1, 1.0, "") for k in range(7, 20)])
    sizes = skew.range_split(df, ["cluster_id"], ["begin_time"]).groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in sizes) < 2500


def test_heavy_keys_at_the_exact_share_and_empty(spark):
    df = _keyed(spark, [(k, 0, i, 1, 1.0, "") for k, n in ((1, 4), (2, 3), (3, 93)) for i in range(n)] + [(None, 0, 0, 0, 0.0, "")] * 50)
    stats = skew.skewed_stats(df, "cluster_id", ["instance"], {"n": F.count(F.lit(1))})
    assert {r[0] for r in skew.heavy_keys(stats, "cluster_id", "n", 0.04).collect()} == {1, 3}
    empty = skew.skewed_stats(df.limit(0), "cluster_id", ["instance"], {"n": F.count(F.lit(1))})
    assert skew.heavy_keys(empty, "cluster_id", "n", 0.04).count() == 0


def test_ordered_stats_are_stitched(spark, split):
    rng = random.Random(2)
    rows = [(rng.choice([6, 6, 6, 7, 8]), rng.randrange(100000), i, 1, 1.0, "") for i in range(2000)] + [(9, 5, 1, 1, 1.0, ""), (None, 1, 1, 1, 1.0, ""), (10, None, 1, 1, 1.0, "")]
    got = {r[0]: tuple(r[1:]) for r in skew.ordered_stats(_keyed(spark, rows), "cluster_id", "begin_time", "instance").collect()}
    for k in (6, 7, 8, 9):
        t = sorted(r[1] for r in rows if r[0] == k)
        assert got[k] == (len(t), t[0], t[-1], max(np.diff(t).tolist(), default=None))
    assert set(got) == {6, 7, 8, 9}


# ---------------------------------------------------------------- 4

HEAD = "# Instance,TaskId,ThreadId,Begin_Time,End_Time,Duration,Line,d_A,d_B,n_A,n_B,x_C,ClusterID"
GOOD = "1,2,3,10,20,10,7,1.5,2,3e2,+0.4,nan,9"


def _lines(spark, records, file="f"):
    rows = [(i, 1, file, i, r, "clash", 0) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "line_id long, trace_id long, file_name string, line_no int, record string, reason string, _header int")


def _reasons(df):
    return {r["line_id"]: r["reason"] for r in df.collect()}


def test_burst_lines(spark):
    cases = {
        HEAD: "none", "# comment": "none", GOOD: None, GOOD + "\r": None, " 1 , 2,3\t,10,20,10,7,1.5,2,3e2,+0.4, nan ,9 ": None,
        ",".join(f'"{x}"' for x in GOOD.split(",")): None, GOOD + "\r\r": "not an integer", "": "blank line", "  \t": "blank line", "\r": "blank line", None: "blank line",
        GOOD.replace("9", '"9'): "broken quoting", GOOD.replace("9", '"9"x'): "broken quoting", GOOD.replace("9", '9"'): "broken quoting", GOOD.replace("nan", '"n""a"'): "not a number",
        GOOD + ",1": "wrong number of fields", GOOD[:-2]: "wrong number of fields", GOOD.replace("10,20", "30,20"): "end before begin", GOOD.replace("9", ""): "not an integer",
        GOOD.replace("9", "-9"): "not an integer", GOOD.replace("9", str(2**31)): "integer out of range", GOOD.replace("9", str(2**31 - 1)): None, GOOD.replace("1,2,3", f"{2**63},2,3"): "integer out of range",
        GOOD.replace("1,2,3", f"000{2**63 - 1},2,3"): None, GOOD.replace("1,2,3", f"1,{2**32},3"): "integer out of range", GOOD.replace("1.5", "1."): "not a number", GOOD.replace("1.5", "nan"): "not a number",
        GOOD.replace("nan", "NaN"): "not a number", GOOD.replace("1,2,3", "1,٣,3"): "not an integer", GOOD.replace("1,2,3", "1,0x2,3"): "not an integer", GOOD.replace("nan", "9" * 100000): None,
        GOOD.replace("nan", '"1,5"'): "not a number", GOOD.replace("1,2,3", '1,"2,3"'): "wrong number of fields",
    }
    got = _reasons(parsing.parse_burst_lines(_lines(spark, list(cases))))
    for i, (record, want) in enumerate(cases.items()):
        assert got.get(i, "none") == want, (record or "")[:80]


def test_burst_values_and_files_without_header(spark):
    rows = parsing.parse_burst_lines(_lines(spark, [HEAD, GOOD]).unionByName(_lines(spark, [GOOD, GOOD], None))).collect()
    one = next(r for r in rows if r["file_name"] == "f")
    assert (one["instance"], one["end_time"], one["line"], one["cluster_id"]) == (1, 20, 7, 9)
    assert one["metrics"] == {"d_A": 1.5, "d_B": 2.0, "n_A": 300.0, "n_B": 0.4, "x_C": None}
    # the first line of the other file stands for its header
    assert [r["reason"] for r in rows if r["file_name"] is None] == [None, None]


def test_semantic_lines(spark):
    cases = {
        "1.2.3\t5\t6\t0": None, " 1.2 \t5 \t 6\t4294967295\r": None, '"1.2"\t5\t"6"\t7': None, "1\t5\t6\t7": "bad object", "1.2.3.4\t5\t6\t7": "bad object", "1.0\t5\t6\t7": "bad object", "1..2\t5\t6\t7": "bad object",
        "1.a\t5\t6\t7": "bad object", "1.4294967296\t5\t6\t7": "integer out of range", "1.2\t5\t6": "wrong number of fields", "1.2\t5\t6\t7\t": "wrong number of fields", "1.2 5 6 7": "wrong number of fields",
        "1.2\t5\t6\t4294967296": "integer out of range", "1.2\t5\t-6\t7": "not an integer", '1.2\t5"\t6\t7': "broken quoting", "": "blank line", None: "blank line", "# x": "wrong number of fields", "1.2\t\t6\t7": "not an integer",
    }
    got = _reasons(parsing.parse_semantic_lines(_lines(spark, list(cases))))
    for i, (record, want) in enumerate(cases.items()):
        assert got[i] == want, record


def test_parsers_of_empty_tables(spark):
    assert parsing.parse_burst_lines(_lines(spark, [""]).limit(0)).count() == 0
    assert parsing.parse_semantic_lines(_lines(spark, [""]).limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=' \t,"a1\r', max_size=12), min_size=1, max_size=6))
def test_index_agrees_with_a_plain_splitter(records):
    import pyarrow as pa

    ix = parsing.Index(pa.array(records), parsing.COMMA)
    field = re.compile(r'[ \t]*("(?:[^"]|"")*"|[^",]*?)[ \t]*(,|$)')
    for i, r in enumerate(records):
        text = r.removesuffix("\r") if r.endswith("\r") else r
        fields, at, ok = [], 0, True
        while ok:
            m = field.match(text, at)
            if not m or (m[1] and not m[1].startswith('"') and '"' in m[1]):
                ok = False
                break
            fields.append(m[1][1:-1].replace('""', '"') if m[1].startswith('"') else m[1].strip(" \t"))
            at = m.end()
            if not m[2]:
                ok = at == len(text)
                break
        assert ok != bool(ix.broken[i]), (r, fields)
        if ok:
            assert ix.fields[i] == len(fields)
            assert [ix.column(np.array([i]), k)[0].as_py() for k in range(len(fields))] == fields
        assert bool(ix.blank[i]) == (not text.strip(" \t"))


# ---------------------------------------------------------------- 5


def brute_faults(bursts, events, traces):
    """The definition row by row, with levels as chains of near values that the source leaves and comes back to."""
    b = bursts.drop_duplicates("instance")
    e = events.dropna(subset=["event_value"]).drop_duplicates(["instance", "event_type"]).merge(b[["instance", "trace_id", "task_id", "thread_id", "begin_time"]], on="instance", suffixes=("_x", ""))
    d = b.dropna(subset=["duration"]).assign(event_type=1, event_value=b.duration)
    cols = ["instance", "trace_id", "task_id", "thread_id", "begin_time", "event_type", "event_value"]
    m = pd.concat([d[cols], e[cols]])
    bad = set()
    for (*_, t), g in m.groupby(["trace_id", "task_id", "thread_id", "event_type"]):
        g = g.sort_values(["begin_time", "instance"])
        v, inst = g.event_value.astype(np.int64).tolist(), g.instance.tolist()
        order = sorted((x, i) for i, x in enumerate(v) if x >= 0)
        chain, chains = [], []
        for x, i in order:
            if chain and not (x <= chain[-1][0] * 1.25 and (x == 0) == (chain[-1][0] == 0)):
                chains.append(chain)
                chain = []
            chain.append((x, i))
        chains += [chain] if chain else []
        good = [c for c in chains if (len(c) > 1 and max(i for _, i in c) - min(i for _, i in c) + 1 > len(c)) or len(c) >= 4]
        if good:
            low, high = min(c[0][0] for c in good), max(c[-1][0] for c in good)
            bad |= {(inst[i], t) for x, i in order if x > 5 * high or x * 5 < low}
        bad |= {(inst[i], t) for i, x in enumerate(v) if x < 0}
        i = 0
        while i < len(v):
            j = i
            while j < len(v) and v[j] == v[i]:
                j += 1
            if j - i >= 5 and len(set(v)) > 1:
                bad |= {(k, t) for k in inst[i:j]}
            i = j
    wide = m.pivot_table(index=["instance", "trace_id"], columns="event_type", values="event_value", aggfunc="max").reset_index().merge(traces, on="trace_id")
    for r in wide.to_dict("records"):
        dur, cyc, ins, i = r.get(1), r.get(42000059), r.get(42000050), r["instance"]
        if cyc == cyc and dur == dur and (i, 1) not in bad and cyc * 1000 > dur * r["clock_mhz"]:
            bad.add((i, 42000059))
        if ins == ins and cyc == cyc and (i, 42000059) not in bad and ins > cyc * r["issue_width"]:
            bad.add((i, 42000050))
    return {(int(a), int(t)) for a, t in bad}


def _tables(spark):
    return [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("bursts", "burst_events", "traces")]


def test_implausible_against_brute_force(spark):
    tables = _tables(spark)
    got = [tuple(r) for r in spikes.implausible(*tables).select("instance", "event_type").collect()]
    want = brute_faults(*[t.toPandas() for t in tables])
    assert len(got) == len(set(got)) and set(got) == want and want


def _one_source(bursts):
    one = bursts.withColumns({"trace_id": F.lit(1).cast("long"), "task_id": F.lit(0).cast("long"), "thread_id": F.lit(0).cast("long")})
    return one.select("*", F.lit("x").alias("clock"), F.lit(1).alias("_any"))


def test_scores_do_not_depend_on_partitions(spark, split):
    """Whole tables, and one source for all rows, in one partition and in 12."""
    bursts, events, traces = _tables(spark)
    number = spark.conf.get("spark.sql.shuffle.partitions")
    for own in (bursts, _one_source(bursts)):
        found = []
        for parts in ("1", "12"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({tuple(r) for r in spikes.implausible(own, events, traces).collect()})
        spark.conf.set("spark.sql.shuffle.partitions", number)
        assert found[0] == found[1] and len({r[2] for r in found[0]}) >= 3


def _piece(values, types=(spikes.DURATION,)):
    """A piece with one source per list of durations."""
    rows = [(t * 10_000 + i, 1, t, 0, i, v) for t, own in enumerate(values) for i, v in enumerate(own)]
    names = ["instance", "trace_id", "task_id", "thread_id", "begin_time", "m1"]
    columns = dict(zip(names, map(list, zip(*rows))))
    return spikes.Piece(pa.table({n: pa.array(c, pa.int64()) for n, c in columns.items()} | {"clock": pa.nulls(len(rows), pa.int64()), "issue": pa.nulls(len(rows), pa.int64())}), list(types))


def test_the_forest_decides_spikes(monkeypatch):
    """No reading is a spike without it, and none is one if it isolates all of them."""
    own = [1000 + (i * 37) % 200 + 90_000 * (i % 4 == 0) for i in range(80)]
    own[33], own[61], own[50] = 9_000_000, 3, 7
    wanted = [33, 50, 61]
    assert sorted(spikes.judge_whole(_piece([own]))["instance"].tolist()) == wanted
    for off in (2.0, -1.0):
        monkeypatch.setattr(spikes, "thresholds", lambda s, g, n, off=off: np.full(n, off))
        assert not len(spikes.judge_whole(_piece([own]))["instance"])


def test_recall_and_precision_of_injected_spikes():
    """Sources with 3 to 6 levels of uneven weight and injected spikes 6 to 60 times beyond them."""
    rng = np.random.default_rng(3)
    values, truth = [], set()
    for s in range(200):
        levels = np.exp(rng.uniform(8, 14, rng.integers(3, 7)))
        n = int(rng.integers(40, 400))
        own = levels[rng.integers(0, len(levels), n)] * np.exp(rng.normal(0, 0.03, n))
        for i in rng.choice(n, rng.integers(0, 3), replace=False):
            factor = np.exp(rng.uniform(np.log(6), np.log(60)))
            own[i] = levels.max() * factor if rng.random() < 0.6 else levels.min() / factor
            truth.add(s * 10_000 + int(i))
        values.append(own.astype(np.int64).tolist())
    found = spikes.judge_whole(_piece(values))
    got = set(found["instance"][found["fault"] == 1].tolist())
    assert len(got & truth) >= 0.98 * len(truth) and len(got & truth) >= 0.98 * len(got)


def test_two_spikes_of_like_height_are_no_level():
    own = [[1000, 8000, 23_000, 70_000][i % 4] + (i * 37) % 200 for i in range(120)]
    own[10], own[33], own[60] = 3_000_000, 3_060_000, 90_000_000
    assert sorted(spikes.judge_whole(_piece([own, own[::-1]]))["instance"].tolist()) == [10, 33, 60, 10_059, 10_086, 10_109]


def _long_source(seed, n=5000):
    """Four levels, and six single spikes far beyond them."""
    rng = np.random.default_rng(seed)
    own = np.exp(rng.uniform(8, 12, 4))[rng.integers(0, 4, n)] * np.exp(rng.normal(0, 0.05, n))
    at = rng.choice(n - 10, 6, replace=False) + 5
    own[at] = own.max() * np.array([8, 14, 25, 45, 80, 140])
    return own.astype(np.int64).tolist(), set(at.tolist())


def test_spikes_of_long_sources_are_found():
    """The threshold lies between the scores of all readings: a sample of 1024 of 5000 holds hardly any of six spikes."""
    for seed in range(8):
        own, wanted = _long_source(seed)
        found = spikes.judge_whole(_piece([own]))
        assert set(found["instance"][found["fault"] == 1].tolist()) == wanted


def test_every_reading_is_in_a_tree():
    for sizes in ([1], [63], [1024], [1025], [70_001], [42, 0, 1500, 42]):
        group, _ = spikes.numbered(np.array(sizes))
        places = spikes.deal(np.array(sizes))
        for g, n in enumerate(sizes):
            often = np.bincount(places[group == g].ravel(), minlength=n)
            assert len(often) == n and (not n or often.max() - often.min() <= 1 and often.min() >= 1)


def test_trees_grown_in_chunks_score_alike(monkeypatch):
    """A cut source's readings, counted in three pieces and scored by trees in several tasks, as in one piece."""
    monkeypatch.setattr(spikes, "CHUNK", 7)
    r = _piece([_long_source(1)[0]]).readings(spikes.DURATION)
    code = spikes.features(r.source, r.level, r.jump, r.pos, r.run_size[r.run], r.levels(), r.jumps())
    keys = dict.fromkeys(spikes.Piece.KEYS, [0] * 3)
    pieces = [pickle.dumps(np.unique(c, return_counts=True)) for c in np.array_split(code, 3)]
    counted = spikes._merge_counts(pa.Table.from_batches([spikes._rows_out(spikes.COUNTED, 3, **keys, event_type=[1] * 3, blob=pieces)]))
    trees = counted.column("trees")[0].as_py()
    chunks = [counted.append_column("chunk", pa.array([c], pa.int64())).to_batches()[0] for c in range(-(-trees // 7))]
    known, found, isolated = pickle.loads(spikes._score_counts(pa.Table.from_batches(spikes._grow_chunk(chunks[::-1]))).column("blob")[0].as_py())
    at = np.searchsorted(known, code)
    assert trees == 79 and len(chunks) == 12 and all((a == b[at]).all() for a, b in zip(r.isolated(code), (found, isolated)))


def test_implausible_of_nulls_and_empty_tables(spark):
    bursts, events, traces = _tables(spark)
    assert spikes.implausible(bursts.limit(0), events.limit(0), traces.limit(0)).count() == 0
    assert spikes.implausible(bursts.limit(0), events, traces).count() == 0
    none = bursts.withColumns({"duration": F.lit(None).cast("long"), "task_id": F.lit(None).cast("long")})
    assert spikes.implausible(none, events.withColumn("event_value", F.lit(None).cast("long")), traces.limit(0)).count() == 0
    found = spikes.implausible(none, events, traces.limit(0)).select("fault").distinct().collect()
    assert "over physical limit" not in {r[0] for r in found}


def test_forest_isolates_the_far_point():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.abs(rng.normal(0, 0.1, (2000, 4))), [[2.5, 2.5, 2.5, 0]]]).astype(np.float32)
    f = spikes.grow(x[spikes.deal(np.array([2001]))])  # the far point is in no sample
    s = spikes.score(f, x, np.zeros(2001, np.int64), np.array([2001]))
    assert s[-1] > 0.6 and s[-1] > s[:-1].max()
