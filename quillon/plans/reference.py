"""Queries of the burst operators over the whole given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import metrics as M
from quillon.operators import assembly, centroid, compare, hulls, neighbors, normalize, ranks, sequence_score, stats
from quillon.operators.dbscan import dbscan
from quillon.runtime import cut, table
from quillon.sources import formats, sinks, trace_text
from quillon.streaming import bursts as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared views

COLUMNS = ["trace_id", "burst_type", "task_id", "thread_id", "begin_time", "end_time", "duration", "line", "d_papi_tot_ins", "d_ipc", "n_papi_tot_ins", "n_ipc", "x_papi_l1_dcm", "cluster_id"]


def bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts without duplicates."""
    return table(spark, folder, "bursts").groupBy("instance").agg(*[F.max(c).alias(c) for c in COLUMNS])


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "burst_events").where("event_value is not null").groupBy("instance", "event_type").agg(F.max("event_value").alias("event_value"))


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """One row per burst with its duration, instructions (a) and cycles (b)."""
    e = events(spark, folder).groupBy("instance").agg(*[F.max(F.when(F.col("event_type") == t, F.col("event_value"))).alias(n) for n, t in (("a", 42000050), ("b", 42000059))])
    return bursts(spark, folder).join(e, "instance", "left")


_B = "b0 AS (SELECT instance, " + ", ".join(f"max({c}) AS {c}" for c in COLUMNS) + " FROM bursts GROUP BY instance)"
_E = "e0 AS (SELECT instance, event_type, max(event_value) AS event_value FROM burst_events WHERE event_value IS NOT NULL GROUP BY ALL)"
_C = f"{_B}, {_E}, c0 AS (SELECT b0.*, p.event_value AS a, q.event_value AS b FROM b0 LEFT JOIN e0 p ON p.instance = b0.instance AND p.event_type = 42000050 LEFT JOIN e0 q ON q.instance = b0.instance AND q.event_type = 42000059)"
#: The stream table as a log: threads are users, types are numbered by name, and `error` switches the counter set.
CODES = {"click": 42000050, "purchase": 42000059, "signup": 42000000, "view": 42000002, "error": 41999999}
_CODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " END"
_L = f"l0 AS (SELECT user_id AS task, CAST(0 AS BIGINT) AS thread, epoch_us(ts) AS ts, event_id AS line, CAST({_CODE} AS BIGINT) AS event_type, CAST(round(value * 100) AS BIGINT) AS event_value FROM events)"


def log(spark: SparkSession, folder: str) -> DataFrame:
    code = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in CODES.items()]).cast("long")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(F.col("user_id").alias("task"), F.lit(0).cast("long").alias("thread"), ts.alias("ts"), F.col("event_id").alias("line"), code.alias("event_type"),
                                                 F.round(F.col("value") * 100).cast("long").alias("event_value"))


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals between neighbouring `view` events of a thread; every other one is running."""
    seen = ranks.neighbours(log(spark, folder).where(F.col("event_type") == CODES["view"]), ["task", "thread"], ["ts", "line"], ["ts"])
    return seen.select("task", "thread", F.col("ts").alias("begin"), F.col("_next.ts").alias("end"), "line", (F.col("line") % 2).cast("int").alias("state")).where("end is not null")


_S = f"{_L}, s0 AS (SELECT * FROM (SELECT task, thread, ts AS \"begin\", lead(ts) OVER (PARTITION BY task, thread ORDER BY ts, line) AS \"end\", line, CAST(line % 2 AS INTEGER) AS state FROM l0 WHERE event_type = {CODES['view']}) WHERE \"end\" IS NOT NULL)"
_J = f"{_S}, j0 AS (SELECT l.*, s.\"begin\", s.\"end\", s.line AS burst_line FROM l0 l JOIN s0 s ON l.task = s.task AND l.thread = s.thread AND s.state = 1 AND l.ts > s.\"begin\" AND l.ts <= s.\"end\")"


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Two-dimensional points: size and price, both scaled to about 1."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") - 900.0) / 1200.0).alias("y"))


_P = "p0 AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS x, (p_retailprice - 900.0) / 1200.0 AS y FROM part)"
EPS, MIN_POINTS = 0.012, 3

# ---------------------------------------------------------------- metrics and burst types


@query(f"WITH {_E} SELECT instance, CAST(sum(event_value) AS BIGINT) AS metric FROM e0 WHERE event_type = 42000050 GROUP BY instance")
def single_event(spark: SparkSession, folder: str) -> DataFrame:
    return M.single_event(events(spark, folder), 42000050)


def _mixed(name: str, op: str, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return counters(spark, folder).select("instance", (F.round if op == "/" else lambda c, _: c)(M.mixed(F.col("a").cast("double"), F.col("b").cast("double"), op), 6).alias("metric")).where("metric is not null")

    QUERIES[name] = run
    SQL[name] = f"WITH {_C} SELECT instance, {sql if op != "/" else f"round({sql}, 6)"} AS metric FROM c0 WHERE a IS NOT NULL AND b IS NOT NULL"


_mixed("mixed_add", "+", "a::DOUBLE + b::DOUBLE")
_mixed("mixed_sub", "-", "a::DOUBLE - b::DOUBLE")
_mixed("mixed_mul", "*", "a::DOUBLE * b::DOUBLE")
_mixed("mixed_div", "/", "CASE WHEN b = 0 THEN 0 ELSE a::DOUBLE / b::DOUBLE END")


@query(f"WITH {_B} SELECT instance, round(CASE WHEN duration = 0 THEN 2.2250738585072014e-308 ELSE ln(duration) END, 9) AS log_duration FROM b0 WHERE duration >= 0")
def log_metric(spark: SparkSession, folder: str) -> DataFrame:
    return bursts(spark, folder).where("duration >= 0").select("instance", F.round(M.log_metric(F.col("duration")), 9).alias("log_duration"))


@query("""SELECT instance, event_type, event_value, CASE WHEN (event_value & 4294967295) >> 30 > 0 THEN xor(event_value & 4294967295, 4294967295) ELSE event_value & 4294967295 END AS fixed
    FROM (SELECT DISTINCT instance, event_type, event_value FROM burst_events WHERE event_value IS NOT NULL)""")
def overflow_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """All counters taken as ones that overflow."""
    e = table(spark, folder, "burst_events").where("event_value is not null").select("instance", "event_type", "event_value").distinct()
    return e.withColumn("fixed", M.overflow_fixed(F.lit(M.OVERFLOW_TYPES[0]), F.col("event_value")))


@query(f"""WITH {_C} SELECT instance, CAST(CASE WHEN m = 1 THEN 1 WHEN duration < 100000 THEN 2 ELSE m END AS INTEGER) AS kind FROM (SELECT *,
    CASE WHEN b IS NULL THEN 1 WHEN b < 100000 THEN 3 WHEN a IS NULL THEN 1 WHEN a < 200000 OR a > 500000000 THEN 3 ELSE 0 END AS m FROM c0)""")
def burst_types(spark: SparkSession, folder: str) -> DataFrame:
    ranges = [M.Parameter("a", low=200000, high=500000000), M.Parameter("b", low=100000)]
    return counters(spark, folder).select("instance", M.burst_type(ranges, 100000).alias("kind"))


@query(f"WITH {_B} SELECT instance, line, duration FROM b0 WHERE NOT (line = 0 AND duration = 0)")
def zero_line_drop(spark: SparkSession, folder: str) -> DataFrame:
    return M.drop_zero_lines(bursts(spark, folder)).select("instance", "line", "duration")


@query("SELECT event_type, coalesce(nullif(regexp_extract(label, '^\\(([^)]*)\\)', 1), ''), nullif(regexp_extract(label, '^([^(\\[][^\\[]*?) ?\\[.*\\]', 1), ''), label) AS counter FROM event_labels WHERE event_type BETWEEN 42000000 AND 42009998")
def all_counters(spark: SparkSession, folder: str) -> DataFrame:
    return M.counters(table(spark, folder, "event_labels"))


@query("SELECT event_type, label FROM event_labels WHERE contains(label, '(PAPI_TOT_INS)')")
def event_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return M.event_by_label(table(spark, folder, "event_labels"), "PAPI_TOT_INS")


@query(f"WITH {_E} SELECT e0.event_type, any_value(label) AS label, count(*) AS event_rows FROM e0 LEFT JOIN event_labels USING (event_type) GROUP BY e0.event_type")
def label_lookup(spark: SparkSession, folder: str) -> DataFrame:
    counted = events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("event_rows"))
    return counted.join(F.broadcast(table(spark, folder, "event_labels")), "event_type", "left").select("event_type", "label", "event_rows")  # a fixed table


@query(f"""WITH {_J} SELECT line, task, "begin", event_type, event_value FROM (SELECT *, max(CASE WHEN ts = "end" THEN 1 ELSE 0 END) OVER (PARTITION BY task, thread, "begin") AS any_end,
    max(CASE WHEN ts = "end" THEN 1 ELSE 0 END) OVER (PARTITION BY task, thread, "begin", event_type) AS own_end FROM j0) WHERE any_end = 0 OR own_end = 1""")
def end_event_semi(spark: SparkSession, folder: str) -> DataFrame:
    inside = assembly.burst_events(log(spark, folder), states(spark, folder))
    return M.usable_types(inside, ["task", "thread", "begin"]).select("line", "task", "begin", "event_type", "event_value")


# ---------------------------------------------------------------- normalisation


@query(f"WITH {_B}, m AS (SELECT min(ln(duration)) AS lo, max(ln(duration)) AS hi FROM b0 WHERE burst_type = 0 AND duration > 0) SELECT instance, round((ln(duration) - lo) / (hi - lo), 9) AS n_duration FROM b0, m WHERE burst_type = 0 AND duration > 0")
def range_norm(spark: SparkSession, folder: str) -> DataFrame:
    own = bursts(spark, folder).where("burst_type = 0 and duration > 0").select("instance", "burst_type", "duration")
    return normalize.range_normalize(own, ["duration"], log=True).select("instance", F.round("n_duration", 9).alias("n_duration"))


@query(f"WITH {_B}, m AS (SELECT avg(d_ipc) AS a, stddev_samp(d_ipc) AS s FROM b0) SELECT instance, round((d_ipc - a) / s, 6) AS z_d_ipc FROM b0, m")
def zscore(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.zscore(bursts(spark, folder).select("instance", "d_ipc"), ["d_ipc"]).select("instance", F.round("z_d_ipc", 6).alias("z_d_ipc"))


@query(f"WITH {_B}, m AS (SELECT avg(d_ipc) AS a FROM b0) SELECT instance, round(d_ipc - a, 9) AS a_d_ipc FROM b0, m")
def mean_adjust(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.mean_adjust(bursts(spark, folder).select("instance", "d_ipc"), ["d_ipc"]).select("instance", F.round("a_d_ipc", 9).alias("a_d_ipc"))


@query(f"WITH {_B} SELECT instance, round(0.6 * n_ipc + 0.8 * n_papi_tot_ins, 9) AS u, round(-0.8 * n_ipc + 0.6 * n_papi_tot_ins, 9) AS v FROM b0 WHERE n_ipc IS NOT NULL AND n_papi_tot_ins IS NOT NULL")
def base_change(spark: SparkSession, folder: str) -> DataFrame:
    own = bursts(spark, folder).dropna(subset=["n_ipc", "n_papi_tot_ins"]).withColumn("w", M.base_change(F.array("n_ipc", "n_papi_tot_ins"), [[0.6, 0.8], [-0.8, 0.6]]))
    return own.select("instance", F.round(F.col("w")[0], 9).alias("u"), F.round(F.col("w")[1], 9).alias("v"))


@query()
def stride_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sampling operator keeps a bounded number of rows by its definition."""
    return normalize.stride_sample(bursts(spark, folder).where("burst_type = 0").select("instance", "task_id", "duration"), 1000)


# ---------------------------------------------------------------- statistics

_STATS = f"{_B}, t AS (SELECT cluster_id, count(*) AS density, CAST(sum(duration) AS BIGINT) AS total_duration, avg(duration) AS av, var_samp(duration) AS va, avg(x_papi_l1_dcm) AS l1 FROM b0 GROUP BY cluster_id)"


@query(f"WITH {_STATS} SELECT cluster_id, density, total_duration, round(av, 3) AS avg_duration, round(sqrt(va), 2) AS sd_duration, round(total_duration / (SELECT sum(total_duration) FROM t), 9) AS share, round(l1, 3) AS avg_l1 FROM t")
def cluster_stats(spark: SparkSession, folder: str) -> DataFrame:
    s = stats.cluster_stats(bursts(spark, folder), metrics=["x_papi_l1_dcm"])
    return s.select("cluster_id", "density", "total_duration", F.round("avg_duration", 3).alias("avg_duration"), F.round(F.sqrt("var_duration"), 2).alias("sd_duration"), F.round("share", 9).alias("share"), F.round("avg_x_papi_l1_dcm", 3).alias("avg_l1"))


_RANK = f"{_STATS}, r AS (SELECT cluster_id, total_duration, CAST(row_number() OVER (ORDER BY total_duration DESC, cluster_id) AS INTEGER) AS ranked_id FROM t WHERE cluster_id <> 5 UNION ALL SELECT cluster_id, total_duration, 0 FROM t WHERE cluster_id = 5)"


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return stats.rank_clusters(stats.cluster_stats(bursts(spark, folder).where("cluster_id is not null")), noise=5)


@query(f"WITH {_RANK} SELECT cluster_id, total_duration, ranked_id FROM r")
def rank_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("cluster_id", "total_duration", "ranked_id")


@query(f"""WITH {_RANK}, k AS (SELECT ranked_id, t.* FROM r JOIN t USING (cluster_id)),
    u AS (SELECT ranked_id, unnest(['density', 'total_duration']) AS statistic, unnest([density::DOUBLE, t_total::DOUBLE]) AS v FROM (SELECT ranked_id, density, total_duration AS t_total FROM k))
    SELECT statistic, max(v) FILTER (ranked_id = 0) AS "NOISE", max(v) FILTER (ranked_id = 1) AS "Cluster 1", max(v) FILTER (ranked_id = 2) AS "Cluster 2", max(v) FILTER (ranked_id = 3) AS "Cluster 3" FROM u GROUP BY statistic""")
def clusters_info(spark: SparkSession, folder: str) -> DataFrame:
    return stats.transposed(_ranked(spark, folder), "ranked_id", ["density", "total_duration"], [0, 1, 2, 3])


@query(f"""WITH {_RANK}, x AS (SELECT cluster_id, avg(d_ipc) AS ipc FROM b0 GROUP BY cluster_id), k AS (SELECT r.ranked_id, t.density, t.total_duration, t.av, t.l1, x.ipc, (SELECT sum(total_duration) FROM r) AS whole FROM r JOIN t USING (cluster_id) JOIN x USING (cluster_id)),
    u AS (SELECT ranked_id, unnest(['density', 'total_duration', 'avg_duration', 'share', 'avg_x_papi_l1_dcm', 'avg_d_ipc']) AS statistic, unnest([density::DOUBLE, total_duration::DOUBLE, av::DOUBLE, total_duration::DOUBLE / whole::DOUBLE, l1::DOUBLE, ipc::DOUBLE]) AS v FROM k)
    SELECT statistic, CASE WHEN ranked_id = 0 THEN 'NOISE' ELSE 'Cluster ' || ranked_id END AS cluster, round(v, 9) AS v FROM u""")
def clusters_info_all(spark: SparkSession, folder: str) -> DataFrame:
    """K2 over all ranked clusters and all its statistics, one row per cell; clusters_info has the first columns of the wide form."""
    means = ["x_papi_l1_dcm", "d_ipc"]
    own = bursts(spark, folder).where("cluster_id is not null")
    ranked = stats.rank_clusters(stats.cluster_stats(own, metrics=means), noise=5)
    return stats.long_form(ranked, "ranked_id", ["density", "total_duration", "avg_duration", "share", *[f"avg_{m}" for m in means]]).withColumn("v", F.round("v", 9))


@query(f"""WITH {_C} SELECT 'duration' AS metric, min(duration)::DOUBLE AS least, (SELECT min(instance) FROM c0 WHERE duration = (SELECT min(duration) FROM c0)) AS least_instance, max(duration)::DOUBLE AS largest,
    (SELECT min(instance) FROM c0 WHERE duration = (SELECT max(duration) FROM c0)) AS largest_instance FROM c0
    UNION ALL SELECT 'a', min(a)::DOUBLE, (SELECT min(instance) FROM c0 WHERE a = (SELECT min(a) FROM c0)), max(a)::DOUBLE, (SELECT min(instance) FROM c0 WHERE a = (SELECT max(a) FROM c0)) FROM c0""")
def extreme_instances(spark: SparkSession, folder: str) -> DataFrame:
    return stats.extremes(counters(spark, folder), ["duration", "a"])


@query(f"WITH {_B}, h AS (SELECT CAST(floor(2 * log10(duration / 1000)) AS INTEGER) AS bucket, count(*) AS bursts, CAST(sum(duration) AS BIGINT) AS time FROM b0 WHERE duration > 0 GROUP BY 1) SELECT bucket, bursts, time, round(time / (SELECT sum(time) FROM h), 9) AS share FROM h")
def duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return stats.duration_histogram(bursts(spark, folder)).withColumn("share", F.round("share", 9))


@query(f"WITH {_B} SELECT CASE WHEN grouping(cluster_id) = 1 THEN 'GLOBAL' ELSE coalesce(cluster_id::VARCHAR, 'none') END AS cluster, count(*) AS occurrences, CAST(sum(duration) AS BIGINT) AS time FROM b0 GROUP BY ROLLUP (cluster_id)")
def global_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return stats.total_rollup(bursts(spark, folder), "cluster_id")


@query(f"WITH {_B} SELECT trace_id, count(DISTINCT cluster_id) AS ids, min(duration) AS least, max(duration) AS most FROM b0 GROUP BY trace_id")
def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    return bursts(spark, folder).groupBy("trace_id").agg(F.countDistinct("cluster_id").alias("ids"), F.min("duration").alias("least"), F.max("duration").alias("most"))


# ---------------------------------------------------------------- assembly


@query(f"WITH {_S} SELECT l.line, l.task, l.ts, s.\"begin\" AS state_begin, s.line AS state_line FROM l0 l LEFT JOIN LATERAL (SELECT * FROM s0 s WHERE s.task = l.task AND s.\"begin\" < l.ts ORDER BY s.\"begin\" DESC, s.line DESC LIMIT 1) s ON true")
def asof_state(spark: SparkSession, folder: str) -> DataFrame:
    s = states(spark, folder).select("task", "thread", "begin", F.col("begin").alias("state_begin"), F.col("line").alias("state_line"))
    found = assembly.as_of(log(spark, folder), s, ["task", "thread"], payload=("state_begin", "state_line"), tie="state_line")
    return found.select("line", "task", "ts", "state_begin", "state_line")


@query(f"WITH {_J} SELECT task, \"begin\", \"end\", burst_line, event_type, CAST(sum(event_value) AS BIGINT) AS total FROM j0 GROUP BY ALL")
def interval_sum(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.sums(assembly.burst_events(log(spark, folder), states(spark, folder))).drop("thread")


@query(f"""WITH {_J} SELECT line, task, event_type FROM (SELECT *, min(CASE WHEN event_type = 41999999 AND ts = "end" THEN line END) OVER (PARTITION BY task, thread, "begin") AS ch FROM j0) WHERE ch IS NULL OR ts <> "end" OR line < ch""")
def counter_set_cut(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.cut_counter_sets(assembly.burst_events(log(spark, folder), states(spark, folder)), order=["line"]).select("line", "task", "event_type")


@query(f"""WITH {_J} SELECT line, task, event_type FROM (SELECT *, min(ts) OVER (PARTITION BY task, thread, "begin", event_type) AS f, min(CASE WHEN event_type = 41999999 AND ts < "end" THEN ts END) OVER (PARTITION BY task, thread, "begin") AS ch FROM j0) WHERE ch IS NULL OR f <= ch""")
def not_common_anti(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.without_late_types(assembly.burst_events(log(spark, folder), states(spark, folder))).select("line", "task", "event_type")


@query(f"WITH {_L} SELECT task, ts AS \"begin\", nx AS \"end\", event_type AS region_type, event_value AS region_value, line FROM (SELECT *, lead(ts) OVER (PARTITION BY task, thread ORDER BY ts, line) AS nx FROM l0 WHERE event_type IN (42000050, 42000059)) WHERE nx IS NOT NULL")
def consecutive_regions(spark: SparkSession, folder: str) -> DataFrame:
    return assembly.consecutive_regions(log(spark, folder), [42000050, 42000059]).drop("thread")


_R = f"{_L}, g0 AS (SELECT task, thread, ts, line, CAST(CASE WHEN event_type = 42000050 THEN event_value ELSE 0 END AS BIGINT) AS v FROM l0 WHERE event_type IN (42000050, 42000059) AND NOT (event_type = 42000050 AND event_value = 0))"


def _regions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A click opens a region, a purchase closes it."""
    own = log(spark, folder).where("event_type in (42000050, 42000059) and not (event_type = 42000050 and event_value = 0)")
    own = own.withColumn("event_value", F.when(F.col("event_type") == 42000050, F.col("event_value")).otherwise(F.lit(0))).withColumn("event_type", F.lit(42000050))
    return assembly.event_regions(own, [42000050])


@query(f"WITH {_R} SELECT task, ts AS \"begin\", nts AS \"end\", v AS region_value, line FROM (SELECT *, lead(v) OVER w AS nv, lead(ts) OVER w AS nts FROM g0 WINDOW w AS (PARTITION BY task, thread ORDER BY ts, line)) WHERE v <> 0 AND nv = 0")
def event_regions(spark: SparkSession, folder: str) -> DataFrame:
    return _regions(spark, folder)[0].select("task", "begin", "end", "region_value", "line")


@query(f"WITH {_R} SELECT task, line FROM (SELECT *, lead(v) OVER w AS nv, lag(v) OVER w AS pv FROM g0 WINDOW w AS (PARTITION BY task, thread ORDER BY ts, line)) WHERE (v <> 0 AND coalesce(nv, 1) <> 0) OR (v = 0 AND coalesce(pv, 0) = 0)")
def unpaired_regions(spark: SparkSession, folder: str) -> DataFrame:
    return _regions(spark, folder)[1].select("task", "line")


@query(f"WITH {_B} SELECT instance, line, cluster_id FROM (SELECT x.instance, x.line, y.cluster_id FROM b0 x LEFT JOIN (SELECT trace_id, line, max(cluster_id) AS cluster_id FROM b0 GROUP BY ALL) y ON x.trace_id = y.trace_id AND x.line = y.line)")
def line_gather(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster ids brought back to bursts by the line of their record, per trace."""
    own = bursts(spark, folder).where("line is not null")
    ids = own.groupBy("trace_id", "line").agg(F.max("cluster_id").alias("cluster_id"))
    return assembly.by_line(ids, own.select("instance", "trace_id", "line"), keys=["trace_id", "line"]).select("instance", "line", "cluster_id")


# ---------------------------------------------------------------- neighbours and density


@query(f"WITH {_P} SELECT a.id, b.id AS other, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 12) AS d2 FROM p0 a JOIN p0 b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS!r}::DOUBLE * {EPS!r}::DOUBLE")
def eps_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.row_pairs(parts(spark, folder), ["x", "y"], EPS, 12)


@query(f"WITH {_P} SELECT a.id, count(*) AS neighbours FROM p0 a JOIN p0 b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS!r}::DOUBLE * {EPS!r}::DOUBLE GROUP BY a.id")
def neighbour_count(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.neighbour_counts(parts(spark, folder), ["x", "y"], EPS)


_KNN = f"{_P}, k0 AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p0 a, p0 b WHERE a.id % 20 = 0), k1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, other) AS INTEGER) AS rank FROM k0)"


@query(f"WITH {_KNN} SELECT id, other, round(d2, 12) AS d2, rank FROM k1 WHERE rank <= 5")
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    own = parts(spark, folder)
    return neighbors.k_nearest(own.where("id % 20 = 0"), own, ["x", "y"], 5).withColumn("d2", F.round("d2", 12))


@query(f"WITH {_KNN} SELECT CAST(rank - 1 AS INTEGER) AS k, id, round(sqrt(d2), 9) AS dist FROM k1 WHERE rank BETWEEN 4 AND 7")
def kdist(spark: SparkSession, folder: str) -> DataFrame:
    own = parts(spark, folder)
    return neighbors.k_distances(own, ["x", "y"], 3, 6, own.where("id % 20 = 0")).withColumn("dist", F.round("dist", 9))


@query(f"""WITH {_P}, q AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p0 a JOIN p0 b ON b.id % 5 = 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {EPS!r}::DOUBLE * {EPS!r}::DOUBLE),
    n AS (SELECT id, CAST(arg_min(other, (d2, other)) % 7 + 1 AS BIGINT) AS c FROM q GROUP BY id) SELECT p0.id, coalesce(c, 0) AS cluster_id FROM p0 LEFT JOIN n USING (id)""")
def nn_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth point is a sample; the classified rows are all."""
    own = parts(spark, folder)
    samples = own.where("id % 5 = 0").withColumn("cluster_id", F.col("id") % 7 + 1)
    return neighbors.nearest_label(own, samples, ["x", "y"], EPS)


@query()
def auto_epsilon(spark: SparkSession, folder: str) -> DataFrame:
    own = parts(spark, folder)
    return neighbors.auto_epsilon(neighbors.k_distances(own, ["x", "y"], 4, 4, own.where("id % 20 = 0")))


_DB = f"""WITH RECURSIVE {_P}, n0 AS MATERIALIZED (SELECT a.id, b.id AS other FROM p0 a JOIN p0 b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS!r}::DOUBLE * {EPS!r}::DOUBLE),
    core AS MATERIALIZED (SELECT id FROM n0 GROUP BY id HAVING count(*) >= {MIN_POINTS}),
    cc AS MATERIALIZED (SELECT n0.id, n0.other FROM n0 JOIN core USING (id) JOIN core c2 ON c2.id = n0.other),
    reach AS (SELECT id, id AS root FROM core UNION SELECT cc.other AS id, reach.root FROM reach JOIN cc ON cc.id = reach.id AND cc.other > reach.root),
    comp AS (SELECT id, min(root) AS start FROM reach GROUP BY id),
    num AS (SELECT start, CAST(row_number() OVER (ORDER BY start) AS INTEGER) AS c FROM (SELECT DISTINCT start FROM comp)),
    lab AS (SELECT id, start, c FROM comp JOIN num USING (start)),
    bord AS (SELECT n0.id, coalesce(max(CASE WHEN n0.other = lab.start THEN c END), min(c)) AS c FROM n0 JOIN lab ON lab.id = n0.other WHERE n0.id NOT IN (SELECT id FROM core) GROUP BY n0.id)
    SELECT p0.id, coalesce(lab.c, bord.c, 0) AS cluster_id FROM p0 LEFT JOIN lab ON lab.id = p0.id LEFT JOIN bord ON bord.id = p0.id"""


@query(_DB)
def dbscan_part(spark: SparkSession, folder: str) -> DataFrame:
    return dbscan(parts(spark, folder), ["x", "y"], EPS, MIN_POINTS)


@query()
def dbscan_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Complete bursts by logarithms of instructions and of their ratio to cycles, all traces together."""
    own = counters(spark, folder).where("a > 0 and b > 0").select(F.col("instance").alias("id"), F.log(F.col("a").cast("double")).alias("x"), (F.col("a") / F.col("b")).alias("y"))
    return dbscan(own, ["x", "y"], 0.02, 20)


# ---------------------------------------------------------------- partitions


_CONT = f"{_B}, u0 AS (SELECT cluster_id AS c1, burst_type AS c2, count(*) AS shared FROM b0 WHERE cluster_id IS NOT NULL GROUP BY ALL)"


def _two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    own = bursts(spark, folder).where("cluster_id is not null")
    return own.select("instance", "cluster_id"), own.select("instance", F.col("burst_type").alias("cluster_id"))


@query(f"WITH {_CONT} SELECT c1, c2, shared FROM u0")
def contingency(spark: SparkSession, folder: str) -> DataFrame:
    return compare.contingency(*_two(spark, folder))


@query(f"""WITH {_CONT}, s AS (SELECT (SELECT sum(n * n) FROM (SELECT sum(shared) AS n FROM u0 GROUP BY c1)) + (SELECT sum(n * n) FROM (SELECT sum(shared) AS n FROM u0 GROUP BY c2)) - 2 * (SELECT sum(shared * shared) FROM u0) AS v, (SELECT sum(shared) FROM u0) AS n)
    SELECT round(v::DOUBLE / (n * n)::DOUBLE, 9) AS distance FROM s""")
def mirkin_distance(spark: SparkSession, folder: str) -> DataFrame:
    return compare.mirkin(*_two(spark, folder)).select(F.round("distance", 9).alias("distance"))


@query(f"WITH {_B} SELECT cluster_id, count(*) AS row_count FROM (SELECT CASE WHEN cluster_id IN (7, 8) THEN 6 ELSE cluster_id END AS cluster_id FROM b0) GROUP BY cluster_id")
def merge_ids(spark: SparkSession, folder: str) -> DataFrame:
    return compare.merge_ids(bursts(spark, folder).select("cluster_id"), [7, 8], 6).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("row_count"))


def _ids(spark: SparkSession, folder: str, rest: int) -> DataFrame:
    return bursts(spark, folder).where((F.col("thread_id") % 2 == rest) & F.col("cluster_id").isNotNull()).select("cluster_id")


def _set_query(name: str, op: str, run) -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, folder: run(_ids(spark, folder, 0), _ids(spark, folder, 1))
    SQL[name] = f"WITH {_B} SELECT cluster_id FROM b0 WHERE thread_id % 2 = 0 AND cluster_id IS NOT NULL {op} SELECT cluster_id FROM b0 WHERE thread_id % 2 = 1 AND cluster_id IS NOT NULL"


_set_query("partition_union", "UNION", lambda a, b: a.union(b).distinct())
_set_query("partition_intersect", "INTERSECT", lambda a, b: a.intersect(b))
_set_query("partition_except", "EXCEPT", lambda a, b: a.subtract(b))

# ---------------------------------------------------------------- sequences

_SEQ = f"{_B}, q0 AS (SELECT trace_id, task_id, thread_id, instance, cluster_id, row_number() OVER (PARTITION BY trace_id, task_id, thread_id ORDER BY instance) AS position FROM b0 WHERE cluster_id >= 5)"


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    own = bursts(spark, folder).where("cluster_id >= 5").select("trace_id", "task_id", "thread_id", "instance", "cluster_id")
    return sequence_score.positions(own, ["trace_id", "task_id", "thread_id"])


@query(f"WITH {_SEQ} SELECT trace_id, task_id, thread_id, instance, position FROM q0")
def seq_position(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder).drop("cluster_id")


@query(f"WITH {_SEQ} SELECT position AS col, cluster_id, count(*) AS occurrences FROM q0 GROUP BY ALL")
def column_occupancy(spark: SparkSession, folder: str) -> DataFrame:
    """Positions as columns: sequences aligned at their begin."""
    return sequence_score.column_occupancy(_positions(spark, folder).withColumnRenamed("position", "col"))


@query(f"""WITH {_SEQ}, t AS (SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, task_id, thread_id FROM q0)), o AS (SELECT position, cluster_id, count(*) AS k FROM q0 GROUP BY ALL),
    w AS (SELECT cluster_id, sum(duration) / (SELECT sum(duration) FROM b0 WHERE cluster_id >= 5) AS weight FROM b0 WHERE cluster_id >= 5 GROUP BY cluster_id)
    SELECT cluster_id, round(avg(k / n), 9) AS score, CAST(sum(k) AS BIGINT) AS occurrences, round(avg(k / n) * any_value(weight), 9) AS weighted FROM o JOIN w USING (cluster_id), t GROUP BY cluster_id""")
def score_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    own = cut(_positions(spark, folder).withColumnRenamed("position", "col"), "positions")
    threads = own.select("trace_id", "task_id", "thread_id").distinct().count()
    weights = stats.cluster_stats(bursts(spark, folder).where("cluster_id >= 5")).select("cluster_id", F.col("share").alias("weight"))
    return sequence_score.score_by_cluster(own, weights, threads).select("cluster_id", F.round("score", 9).alias("score"), "occurrences", F.round("weighted", 9).alias("weighted"))


@query("""WITH q AS (SELECT DISTINCT c_nationkey AS cluster_id, n_regionkey AS col FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT cluster_id, list_sort(list(col)) AS cols FROM q GROUP BY cluster_id),
    m AS (SELECT cols, min(cluster_id) AS merged, count(*) AS n FROM s GROUP BY cols) SELECT cluster_id, merged FROM s JOIN m USING (cols) WHERE n > 1""")
def identical_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as clusters and regions as columns: those of one region occupy the same."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("col"))
    return sequence_score.identical_columns(table(spark, folder, "customer").join(nations, "c_nationkey").select(F.col("c_nationkey").alias("cluster_id"), "col"))


@query(f"""WITH {_SEQ}, s AS (SELECT cluster_id, list_sort(list(DISTINCT position)) AS cols FROM q0 GROUP BY cluster_id), m AS (SELECT cols, min(cluster_id) AS merged, count(*) AS n FROM s GROUP BY cols)
    SELECT cluster_id, merged FROM s JOIN m USING (cols) WHERE n > 1""")
def identical_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions as columns; clusters of the same ones are rare."""
    return sequence_score.identical_columns(_positions(spark, folder).withColumnRenamed("position", "col"))


@query(f"WITH {_B} SELECT instance, CASE WHEN cluster_id IS NULL THEN '-' WHEN cluster_id BETWEEN 0 AND 20 THEN substr('ABCDEFGHIKLMNPQRSTVWYZ', cluster_id + 1, 1) WHEN cluster_id = 21 THEN 'Z' ELSE 'X' END AS letter FROM b0")
def sequence_letters(spark: SparkSession, folder: str) -> DataFrame:
    return sequence_score.as_letters(bursts(spark, folder)).select("instance", "letter")


@query()
def aligned_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Progressive alignment of the threads' whole sequences of every trace, then scores."""
    own = cut(bursts(spark, folder).where("cluster_id >= 5").select("trace_id", "task_id", "thread_id", "instance", "cluster_id", "duration"), "own")
    weights = own.groupBy("trace_id", "cluster_id").agg(F.sum("duration").alias("d")).withColumn("weight", F.coalesce(F.col("d") / F.sum("d").over(Window.partitionBy("trace_id")), F.lit(0.0)))
    aligned = cut(sequence_score.aligned_sequences(own.drop("duration"), weights.select("trace_id", "cluster_id", "weight")), "aligned")
    threads = own.select("trace_id", "task_id", "thread_id").distinct().groupBy("trace_id").agg(F.count(F.lit(1)).alias("threads"))
    per = aligned.where("cluster_id is not null").groupBy("trace_id", "window", "col", "cluster_id").agg(F.count(F.lit(1)).alias("n")).join(threads, "trace_id")
    return per.groupBy("trace_id", "cluster_id").agg(F.round(F.avg(F.col("n") / F.col("threads")), 6).alias("score"), F.sum("n").alias("occurrences"))


@query(f"""WITH {_SEQ}, t AS (SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, task_id, thread_id FROM q0)), o AS (SELECT position, cluster_id, count(*) AS k FROM q0 GROUP BY ALL),
    w AS (SELECT cluster_id, sum(duration) / (SELECT sum(duration) FROM b0 WHERE cluster_id >= 5) AS weight FROM b0 WHERE cluster_id >= 5 GROUP BY cluster_id),
    p AS (SELECT cluster_id - 5 AS c, avg(k / n) AS score, CAST(sum(k) AS BIGINT) AS occurrences, avg(k / n) * any_value(weight) AS weighted FROM o JOIN w USING (cluster_id), t GROUP BY cluster_id)
    SELECT CASE WHEN c = 0 THEN 'NOISE' ELSE 'Cluster ' || c END AS cluster, round(score, 9) AS score, occurrences, round(weighted, 9) AS weighted FROM p
    UNION ALL SELECT 'GLOBAL', round(sum(weighted), 9), CAST(sum(occurrences) AS BIGINT), round(sum(weighted), 9) FROM p""")
def scores_csv(spark: SparkSession, folder: str) -> DataFrame:
    own = cut(_positions(spark, folder).withColumnRenamed("position", "col"), "positions").withColumn("cluster_id", F.col("cluster_id") - 5)
    threads = own.select("trace_id", "task_id", "thread_id").distinct().count()
    weights = stats.cluster_stats(bursts(spark, folder).where("cluster_id >= 5")).select((F.col("cluster_id") - 5).alias("cluster_id"), F.col("share").alias("weight"))
    return sinks.scores_csv(sequence_score.score_by_cluster(own, weights, threads)).select("cluster", F.round("score", 9).alias("score"), "occurrences", F.round("weighted", 9).alias("weighted"))


# ---------------------------------------------------------------- hulls and grids


@query("""WITH m AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part),
    c AS (SELECT p_partkey AS instance, p_brand, CAST(least(floor((p_size - x0) / (x1 - x0) * 50), 49) AS INTEGER) AS cell_x, CAST(least(floor((p_retailprice - y0) / (y1 - y0) * 50), 49) AS INTEGER) AS cell_y FROM part, m)
    SELECT instance, cell_x, cell_y, support FROM c JOIN (SELECT cell_x, cell_y, count(DISTINCT p_brand) AS support FROM c GROUP BY ALL) USING (cell_x, cell_y)""")
def support_grid(spark: SparkSession, folder: str) -> DataFrame:
    return hulls.support_grid(table(spark, folder, "part").select(F.col("p_partkey").alias("instance"), "p_size", "p_retailprice", "p_brand"), "p_size", "p_retailprice", "p_brand")


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    own = counters(spark, folder).where("a > 0 and b > 0 and cluster_id >= 5").select("instance", (F.col("cluster_id") - 5).alias("cluster_id"), "duration", F.log(F.col("a").cast("double")).alias("x"), F.log(F.col("b").cast("double")).alias("y"))
    return own


@query()
def hull_vertices(spark: SparkSession, folder: str) -> DataFrame:
    model = hulls.hulls(_clustered(spark, folder), "x", "y")
    return model.select("cluster_id", "density", "total_time", F.size("points").alias("corners"))


@query()
def hull_classify(spark: SparkSession, folder: str) -> DataFrame:
    own = _clustered(spark, folder)
    model = cut(hulls.global_model(hulls.hulls(own, "x", "y"), 10), "hulls")
    return hulls.classify(own, model, "x", "y")


# ---------------------------------------------------------------- centroids

CENTRES = [[0.1, 0.2], [0.5, 0.5], [0.9, 0.8], [0.3, 0.9]]
_DIST = [f"(x - {x!r}) * (x - {x!r}) + (y - {y!r}) * (y - {y!r})" for x, y in CENTRES]
_KM = f"{_P}, d0 AS (SELECT id, x, y, [" + ", ".join(_DIST) + "] AS d FROM p0), a0 AS (SELECT id, x, y, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS centre FROM d0)"


@query(f"WITH {_KM} SELECT id, centre FROM a0")
def kmeans_assign(spark: SparkSession, folder: str) -> DataFrame:
    return centroid.assign(parts(spark, folder), ["x", "y"], CENTRES).select("id", "centre")


@query(f"WITH {_KM} SELECT centre, round(avg(x), 9) AS x, round(avg(y), 9) AS y, count(*) AS n FROM a0 GROUP BY centre")
def kmeans_update(spark: SparkSession, folder: str) -> DataFrame:
    return centroid.update(centroid.assign(parts(spark, folder), ["x", "y"], CENTRES), ["x", "y"]).select("centre", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "n")


@query()
def anderson_darling(spark: SparkSession, folder: str) -> DataFrame:
    own = bursts(spark, folder).where("duration > 0 and cluster_id >= 6").select("cluster_id", F.log(F.col("duration").cast("double")).alias("v"))
    return centroid.anderson_darling(own, "cluster_id", "v").select("cluster_id", "n", F.round("statistic", 4).alias("statistic"))


@query()
def gmeans(spark: SparkSession, folder: str) -> DataFrame:
    return centroid.gmeans(parts(spark, folder), ["x", "y"], 50.0, 8)


@query()
def clara(spark: SparkSession, folder: str) -> DataFrame:
    return centroid.clara(parts(spark, folder), ["x", "y"], 4)[1]


# ---------------------------------------------------------------- text in and out


def _state_text(spark: SparkSession, folder: str) -> DataFrame:
    own = bursts(spark, folder).where("end_time is not null and line is not null")
    named = own.select("instance", F.lit(0).alias("cpu"), F.lit(1).alias("app"), F.col("task_id").alias("task"), F.col("thread_id").alias("thread"), F.col("begin_time").alias("begin"), F.col("end_time").alias("end"), F.lit(1).alias("state"))
    return named.select(F.col("instance").alias("line"), trace_text.state_lines(named).alias("value"))


@query(f"WITH {_B} SELECT instance AS line, task_id AS task, thread_id AS thread, begin_time AS \"begin\", end_time AS \"end\" FROM b0 WHERE end_time IS NOT NULL AND line IS NOT NULL")
def state_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts written as state records and read back."""
    return trace_text.states(trace_text.records(_state_text(spark, folder))).select("line", "task", "thread", "begin", "end")


def _event_text(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("event_type", "event_value"))).alias("pairs"))  # at most one pair per type
    own = bursts(spark, folder).join(e, "instance").where("end_time is not null")
    named = own.select("instance", F.lit(0).alias("cpu"), F.lit(1).alias("app"), F.col("task_id").alias("task"), F.col("thread_id").alias("thread"), F.col("end_time").alias("ts"), "pairs")
    return named.select(F.col("instance").alias("line"), trace_text.event_lines().alias("value"))


@query(f"WITH {_B}, {_E} SELECT instance AS line, task_id AS task, thread_id AS thread, end_time AS ts, event_type, event_value FROM e0 JOIN b0 USING (instance) WHERE end_time IS NOT NULL")
def event_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counters written as event records and read back."""
    return trace_text.events(trace_text.records(_event_text(spark, folder))).select("line", "task", "thread", "ts", "event_type", "event_value")


@query(f"WITH {_B}, {_E} SELECT instance AS line, task_id AS task FROM b0 WHERE end_time IS NOT NULL AND task_id = 0 AND instance IN (SELECT instance FROM e0)")
def task_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Event records of the master task only."""
    recs = trace_text.records(_event_text(spark, folder), [trace_text.EVENT], tasks=[0])
    return trace_text.events(recs).select("line", "task").distinct()


@query("SELECT o_orderkey AS line, o_custkey AS src_task, o_custkey % 7 AS dst_task, CAST(round(o_totalprice) AS BIGINT) AS size, o_orderkey % 5 AS tag FROM orders")
def comm_scan(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    zero = ["src_cpu", "src_thread", "log_send", "phy_send", "dst_cpu", "dst_thread", "log_recv", "phy_recv"]
    named = o.select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("src_task"), (F.col("o_custkey") % 7).alias("dst_task"), F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 5).alias("tag"),
                     F.lit(1).alias("src_app"), F.lit(1).alias("dst_app"), *[F.lit(0).alias(z) for z in zero])
    lines = named.select("line", trace_text.comm_lines().alias("value"))
    return trace_text.communications(trace_text.records(lines)).select("line", "src_task", "dst_task", "size", "tag")


@query("SELECT o_orderkey AS line, o_custkey AS task, o_orderkey % 3 AS communicator, CAST(round(o_totalprice) AS BIGINT) AS send_size, o_orderkey % 11 AS op_id FROM orders")
def globalop_scan(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    named = o.select(F.col("o_orderkey").alias("line"), F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 3).alias("communicator"), F.round("o_totalprice").cast("long").alias("send_size"), (F.col("o_orderkey") % 11).alias("op_id"),
                     F.lit(1).alias("app"), *[F.lit(0).alias(z) for z in ("cpu", "thread", "ts", "recv_size", "root")])
    lines = named.select("line", trace_text.globalop_lines().alias("value"))
    return trace_text.global_operations(trace_text.records(lines)).select("line", "task", "communicator", "send_size", "op_id")


@query(f"WITH {_B} SELECT instance AS line, task_id AS task, thread_id AS thread, CAST(round(round(duration / 1e9, 9) * 1e9) AS BIGINT) AS duration FROM b0 WHERE duration >= 0")
def simulator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts written as the simulator's records in seconds and read back in ns."""
    own = bursts(spark, folder).where("duration >= 0")
    text = F.format_string('"CPU burst" { %d, %d, %.9f };;', "task_id", "thread_id", F.col("duration") / 1e9)
    return formats.simulator_bursts(own.select(F.col("instance").alias("line"), text.alias("value"))).select("line", "task", "thread", "duration")


@query(f"""WITH {_B} SELECT instance, concat_ws(',', instance, task_id, thread_id, begin_time, coalesce(end_time::VARCHAR, 'nan'), coalesce(duration::VARCHAR, 'nan'), line,
    coalesce(printf('%.0f', d_papi_tot_ins), 'nan'), coalesce(printf('%.6f', d_ipc), 'nan'), coalesce(printf('%.6f', n_ipc), 'nan'), coalesce(printf('%.0f', x_papi_l1_dcm), 'nan'), coalesce(cluster_id, 0)) AS value FROM b0 WHERE burst_type <> 1""")
def bursts_csv(spark: SparkSession, folder: str) -> DataFrame:
    """CSV rows; the table's ids carry the offset already."""
    return sinks.burst_csv_rows(bursts(spark, folder), ["d_papi_tot_ins", "d_ipc"], ["n_ipc"], ["x_papi_l1_dcm"], ["d_ipc"], offset=0)


@query(f"""WITH {_B}, m AS (SELECT task_id AS task, thread_id AS thread, begin_time AS ts, 1 AS o, coalesce(cluster_id, 0) + 5 AS v FROM b0 WHERE end_time IS NOT NULL UNION ALL SELECT task_id, thread_id, end_time, 0, 0 FROM b0 WHERE end_time IS NOT NULL)
    SELECT task, thread, ts, string_agg('90000001:' || v, ':' ORDER BY o, v) AS pairs FROM m GROUP BY ALL""")
def annotated_states(spark: SparkSession, folder: str) -> DataFrame:
    marks = sinks.annotations(bursts(spark, folder))
    return marks.select("task", "thread", "ts", F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["event_type"], p["event_value"])), ":").alias("pairs"))


_N = "CAST(coalesce(cluster_id, 0) + 5 AS BIGINT)"


@query(f"""WITH {_B}, n AS (SELECT *, {_N} AS v FROM b0 WHERE duration >= 0), u AS (SELECT instance AS line, 0 AS part, printf('"user event" {{{{ %d, %d, 90000001, %d }}}};;', task_id, thread_id, v) AS value FROM n
    UNION ALL SELECT instance, 1, printf('"block begin" {{{{ %d, %d, %d }}}};;', task_id, thread_id, v) FROM n UNION ALL SELECT instance, 2, printf('"CPU burst" {{{{ %d, %d, %d.%06d }}}};;', task_id, thread_id, (duration + 500) // 1000000000, ((duration + 500) // 1000) % 1000000) FROM n
    UNION ALL SELECT instance, 3, printf('"block end" {{{{ %d, %d, %d }}}};;', task_id, thread_id, v) FROM n UNION ALL SELECT instance, 4, printf('"user event" {{{{ %d, %d, 90000001, 0 }}}};;', task_id, thread_id) FROM n) SELECT line, CAST(part AS INTEGER) AS part, value FROM u""".replace("{{", "{").replace("}}", "}"))
def annotated_simulator(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts as the simulator's records, with cluster events and blocks around each."""
    own = bursts(spark, folder).where("duration >= 0")
    lines = own.select(F.col("instance").alias("line"), sinks.cpu_burst(F.col("task_id"), F.col("thread_id"), F.col("duration")).alias("value"))
    return sinks.annotated_simulator(lines, own.drop("line").withColumnRenamed("instance", "line"), blocks=True)


@query(f"WITH {_B} SELECT instance, concat_ws(',', instance, task_id, thread_id, begin_time, coalesce(end_time::VARCHAR, 'nan'), coalesce(duration::VARCHAR, 'nan'), line, cluster_id) AS value FROM b0 WHERE burst_type = 0 AND cluster_id IS NOT NULL")
def bursts_csv_clustered(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.burst_csv_rows(bursts(spark, folder), [], [], [], offset=0, scope="clustering")


@query(f"WITH {_B} SELECT trace_id, task_id, count(*) AS backends, avg(d_ipc) AS d_ipc, CAST(floor(avg(line)) AS BIGINT) AS line FROM b0 WHERE line IS NOT NULL GROUP BY ALL")
def run_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as experiments, tasks as runs."""
    return stats.run_averages(bursts(spark, folder).where("line is not null"), ["trace_id", "task_id"], ["d_ipc", "line"], whole=["line"])


@query(f"WITH {_KNN} SELECT CAST(rank - 1 AS INTEGER) AS k, printf('%.6f', sqrt(d2)) AS value FROM k1 WHERE rank = 5")
def kdist_file(spark: SparkSession, folder: str) -> DataFrame:
    own = parts(spark, folder)
    return sinks.kdist_rows(neighbors.k_distances(own, ["x", "y"], 4, 4, own.where("id % 20 = 0")))


# ---------------------------------------------------------------- streams


@query("SELECT cluster_id, count(*) AS row_count, CAST(sum(duration) AS BIGINT) AS total FROM bursts GROUP BY cluster_id")
def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    stream = streaming.table_stream(spark, folder, "bursts")
    return streaming.totals(stream, ["cluster_id"], {"row_count": F.count(F.lit(1)), "total": F.sum("duration")}, {"row_count": F.sum("row_count"), "total": F.sum("total")})


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, loaded_at)) AS start_us, trace_id, count(*) AS row_count FROM bursts GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per trace and day of loading; a year of lateness, as files aren't in order."""
    stream = streaming.table_stream(spark, folder, "bursts").withColumn("at", F.col("loaded_at").cast("timestamp"))
    out = streaming.windows(stream, "at", ["trace_id"], "1 day", "400 days", {"row_count": F.count(F.lit(1))})
    return out.select(F.unix_micros("start").alias("start_us"), "trace_id", "row_count")
