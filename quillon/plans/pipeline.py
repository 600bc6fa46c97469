"""The whole analysis as one object: extract, cluster, refine, describe, annotate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import metrics as M
from quillon.operators import assembly, centroid, hulls, refine
from quillon.operators.dbscan import dbscan
from quillon.operators.neighbors import k_distances, nearest_label
from quillon.operators.normalize import range_normalize, stride_sample
from quillon.operators.ranks import ranked
from quillon.operators.sequence_score import aligned_sequences, identical_columns, score_by_cluster
from quillon.operators.stats import cluster_stats, rank_clusters
from quillon.runtime import cut, dim_join
from quillon.sources import formats, sinks, trace_text

Algorithm = Callable[[DataFrame, Sequence[str], dict[str, str]], DataFrame]
#: Clustering algorithms by name; each takes points (id and dims) and gives (id, cluster_id).
ALGORITHMS: dict[str, Algorithm] = {
    "DBSCAN": lambda p, d, a: dbscan(p, d, float(a["epsilon"]), int(a["min_points"])),
    "GMEANS": lambda p, d, a: centroid.gmeans(p, d, float(a["critical_value"]), int(a.get("max_clusters", 30))),
    "MUSTER_DBSCAN": lambda p, d, a: dbscan(p, d, float(a["epsilon"]), int(a["min_points"])),
    "MUSTER_PAM": lambda p, d, a: centroid.best_medoids(p, d, int(a["max_clusters"]))[1],
    "MUSTER_XCLARA": lambda p, d, a: centroid.clara(p, d, int(a["max_clusters"]))[1],
    "MUSTER_CAPEK": lambda p, d, a: centroid.medoids(p, d, int(a["k"]))[1],
}


class Analysis:
    """Bursts with columns instance, task_id, thread_id, begin_time, end_time, duration, line and one per event type."""

    def __init__(self, definition: config.Pipeline) -> None:
        self.definition = definition
        self.dims = [f"n_{m.name}" for m in self.metrics]
        self.extrapolated: list[config.Metric] = []

    @classmethod
    def from_xml(cls, path: str) -> Analysis:
        return cls(config.load(path))

    def with_dbscan(self, eps: float, min_points: int) -> Analysis:
        self.definition.algorithm, self.definition.arguments = "DBSCAN", {"epsilon": str(eps), "min_points": str(min_points)}
        return self

    @property
    def metrics(self) -> list[config.Metric]:
        """Clustering metrics: a semantic value and the duration, if used, come first (P6, P7); the definition's apply_log is the duration's."""
        own = list(self.definition.clustering)
        own = [config.Metric("Duration", "duration", log=self.definition.apply_log), *own] if self.definition.use_duration else own
        return [config.Metric("Semantic_Value", "semantic", log=self.definition.semantic_log), *own] if self.definition.use_semantic else own

    def extract(self, lines: DataFrame, events: Sequence[int] | None = None, consecutive: bool = False) -> DataFrame:
        """Bursts of a text log: running states, or regions of the given event types; times in ns, by the header's unit."""
        first = lines.where("line = 1").first()
        factor = trace_text.header(first["value"]).time_factor if first and first["value"].startswith("#") else 1
        scaled = lambda df, *times: df.withColumns({t: F.col(t) * factor for t in times}) if factor != 1 else df
        recs = trace_text.records(lines, (trace_text.STATE, trace_text.EVENT))
        seen = scaled(trace_text.events(recs), "ts")
        if events is None:
            spans, running = scaled(trace_text.states(recs), "begin", "end"), 1
        else:
            spans, running = (assembly.consecutive_regions(seen, events) if consecutive else assembly.event_regions(seen, events)[0]), None
        inside = assembly.cut_counter_sets(assembly.burst_events(seen, spans, running=running))
        if events is not None:
            inside = assembly.without_late_types(inside.where(~F.col("event_type").isin(*events)))
        usable = M.usable_types(inside, ["task", "thread", "begin"])
        totals = assembly.sums(usable).groupBy("task", "thread", "begin").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "total"))).alias("counters"))
        kept = spans if running is None else spans.where(F.col("state") == running)
        joined = ranked(kept.join(totals, ["task", "thread", "begin"], "left"), [], ["end", "task", "thread", "begin"], "instance")  # W1: in the order they close
        return joined.select("instance", F.col("task").alias("task_id"), F.col("thread").alias("thread_id"), F.col("begin").alias("begin_time"),
                             F.col("end").alias("end_time"), (F.col("end") - F.col("begin")).alias("duration"), "line", "counters")

    def from_simulator(self, lines: DataFrame) -> DataFrame:
        """Bursts of the simulator's records, which know durations but no times."""
        own = ranked(formats.simulator_bursts(lines), [], ["line", "task", "thread"], "instance")
        nothing = F.lit(None).cast("long")
        return own.select("instance", F.col("task").alias("task_id"), F.col("thread").alias("thread_id"), nothing.alias("begin_time"), nothing.alias("end_time"), "duration", "line", "counters")

    def prepare(self, bursts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """Metrics, burst types, normalised metrics n_<name> and extrapolated ones x_<name>.

        Event types come from columns m<type> or the map ``counters``; they may be given by their labels (P9), if
        ``labels`` (event_type, label) are. ``all_counters`` needs labels too. Ranges of extrapolated metrics don't count.
        """
        self.extrapolated = list(self.definition.extrapolation)
        if self.definition.all_counters and labels is not None:
            known = {m.name for m in self.extrapolated}
            rows = M.counters(labels).orderBy("event_type").collect()  # a label table
            self.extrapolated += [config.Metric(r["counter"], str(r["event_type"])) for r in rows if r["counter"] not in known]
        codes: dict[str, str] = {}

        def code_of(text: str) -> str:
            if text.isdigit() or text in ("duration", "semantic"):
                return text
            if text not in codes:
                found = M.event_by_label(labels, text).first() if labels is not None else None
                if found is None:
                    raise config.ConfigError(f"no event type has the label {text!r}")
                codes[text] = str(found["event_type"])
            return codes[text]

        def value(text: str):  # noqa: ANN202
            code = code_of(text)
            if code == "duration":
                return F.col("duration")
            if code == "semantic":
                return F.col("semantic_value")
            return F.col(f"m{code}") if f"m{code}" in bursts.columns else F.element_at("counters", F.lit(int(code)).cast("long")) if "counters" in bursts.columns else F.lit(None).cast("long")

        def raw(m: config.Metric):  # noqa: ANN202
            return (value(m.a).cast("double") if m.b is None else M.mixed(value(m.a), value(m.b), m.operation)) * m.factor

        own = bursts.withColumns({m.name: raw(m) for m in self.metrics if m.a not in ("duration", "semantic")} | {f"x_{m.name}": raw(m) for m in self.extrapolated})
        parameters = [M.Parameter(m.name, low=m.low, high=m.high) for m in self.metrics]
        own = own.withColumn("burst_type", M.burst_type(parameters, self.definition.duration_filter))
        for m in self.metrics:
            if self.definition.normalize:
                own = range_normalize(own, [m.name], complete="burst_type = 0", log=m.log)
            else:
                own = own.withColumn(f"n_{m.name}", M.log_metric(F.col(m.name)) if m.log else F.col(m.name))
        return own

    def cluster(self, bursts: DataFrame, most: int | None = None) -> DataFrame:
        """Bursts with cluster_id: complete ones clustered and ranked by time. With ``most`` a sample is clustered and the rest takes the nearest sample's cluster."""
        run = ALGORITHMS[self.definition.algorithm]
        points = cut(bursts.where("burst_type = 0").select(F.col("instance").alias("id"), "task_id", *self.dims), "points")
        sample = points if most is None else cut(stride_sample(points, most, order="id"), "sample")
        labels = cut(run(sample, self.dims, self.definition.arguments), "labels")
        if most is not None:
            known = sample.join(labels, "id")
            rest = points.join(sample.select("id"), "id", "left_anti")
            labels = labels.unionByName(nearest_label(rest, known.where("cluster_id > 0"), self.dims, float(self.definition.arguments["epsilon"])))
        labelled = bursts.join(labels.withColumnRenamed("id", "instance"), "instance", "left")
        names = rank_clusters(cluster_stats(labelled.where("cluster_id is not null"))).select("cluster_id", "ranked_id")
        renamed = dim_join(labelled, cut(names, "names"), ["cluster_id"], "left").drop("cluster_id").withColumnRenamed("ranked_id", "cluster_id")
        return self._threshold(renamed)

    def _threshold(self, bursts: DataFrame) -> DataFrame:
        """F7, only if asked for: clusters of less than this percentage of the time become id -1."""
        if not self.definition.threshold_filter:
            return bursts
        small = cluster_stats(bursts.where("cluster_id > 0")).where(F.col("share") * 100 < self.definition.threshold_filter).select("cluster_id", F.lit(True).alias("_small"))
        return dim_join(bursts, small, ["cluster_id"], "left").withColumn("cluster_id", F.when(F.col("_small"), -1).otherwise(F.col("cluster_id"))).drop("_small")

    def stats(self, bursts: DataFrame) -> DataFrame:
        """Statistics of the clusters, with the mean of each extrapolated metric (avg_x_<name>) and of each clustering metric (A5, avg_<name>)."""
        return cluster_stats(bursts.where("burst_type = 0"), metrics=[*(f"x_{m.name}" for m in self.extrapolated), *(m.name for m in self.metrics)])

    def kdist(self, bursts: DataFrame, k_begin: int, k_end: int) -> DataFrame:
        points = bursts.where("burst_type = 0").select(F.col("instance").alias("id"), *self.dims)
        return k_distances(points, self.dims, k_begin, k_end)

    def _aligned(self, bursts: DataFrame, group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Complete bursts, their clusters' shares of time (of all, and per group for the alignment), and the aligned sequences."""
        own = bursts.where("burst_type = 0")
        own = own if group in own.columns else own.withColumn(group, F.lit(1).cast("long"))
        shares = cluster_stats(own).select("cluster_id", F.col("share").alias("weight"))
        per = own.groupBy(group, "cluster_id").agg(F.sum("duration").alias("_d"))
        per = per.withColumn("weight", F.coalesce(F.col("_d") / F.sum("_d").over(Window.partitionBy(group)), F.lit(0.0))).drop("_d")
        return own, shares, cut(aligned_sequences(own, per, group), "aligned")

    def score(self, bursts: DataFrame, group: str = "trace_id") -> DataFrame:
        """Scores of the clusters by the alignment of the threads of each trace."""
        own, shares, aligned = self._aligned(bursts, group)
        threads = own.select(group, "task_id", "thread_id").distinct().count()
        return score_by_cluster(aligned, shares, max(1, threads))

    def refine(self, bursts: DataFrame, ladder: Sequence[float], min_points: int, divisive: bool = False) -> tuple[DataFrame, list[refine.Node]]:
        own = cut(bursts.where("burst_type = 0"), "refined")
        points = own.select(F.col("instance").alias("id"), "duration", *self.dims)

        def labelled(labels: DataFrame) -> DataFrame:
            return own.drop("cluster_id").join(labels.withColumnRenamed("id", "instance"), "instance").withColumn("trace_id", F.lit(1).cast("long"))

        def score(labels: DataFrame) -> dict[int, tuple[float, int]]:
            return {r["cluster_id"]: (r["score"], r["occurrences"]) for r in self.score(labelled(labels)).collect()}  # one row per cluster

        def merge(labels: DataFrame) -> dict[int, int]:
            aligned = self._aligned(labelled(labels), "trace_id")[2]
            return {r["cluster_id"]: r["merged"] for r in identical_columns(aligned.where("cluster_id > 0")).collect()}  # one row per merged cluster

        if divisive:
            return refine.refine_divisive(points, self.dims, ladder, min_points, score)
        return refine.refine_aggregative(points, self.dims, ladder, min_points, score, merge)

    def hull_model(self, bursts: DataFrame) -> DataFrame:
        return hulls.hulls(bursts.where("burst_type = 0"), *self.dims[:2])

    def annotate(self, lines: DataFrame, bursts: DataFrame, only_events: bool = False, hide_filtered: bool = False) -> DataFrame:
        """The log with cluster events; lines keep their time where they have one."""
        ts = F.get(F.split("value", ":"), F.lit(5)).try_cast("long")
        timed = lines.withColumn("ts", F.when(F.col("value").rlike("^[1-4]:"), ts).otherwise(F.lit(-1)))
        return sinks.annotated(timed, sinks.annotations(bursts, hide_filtered), only_events)
