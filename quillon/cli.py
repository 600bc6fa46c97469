"""Command line: ``python -m quillon cluster|extract|kdist|diff|score ...``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.metrics import nanoseconds
from quillon.operators import compare
from quillon.operators.parsing import parse_burst_lines
from quillon.operators.sequence_score import sequence_lines
from quillon.operators.stats import long_form
from quillon.plans.pipeline import Analysis
from quillon.sources import formats, sinks, trace_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description="Burst analytics on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        own = sub.add_parser(name, help=text)
        own.add_argument("-i", "--input", required=True, help="a log, simulator records, or a burst CSV")
        own.add_argument("-o", "--output", required=True, help="folder of the results")
        return own

    def defined(own: argparse.ArgumentParser) -> None:
        own.add_argument("-d", "--definition", required=True, help="definition in XML")
        own.add_argument("-l", "--labels", help="label file of event types")
        own.add_argument("-e", "--events", help="event types whose regions are the bursts, by comma")
        own.add_argument("-c", "--consecutive", action="store_true", help="each of these events closes a region and opens the next")
        own.add_argument("-b", "--least-duration", help="bursts below it are filtered, as 10us, 1ms (microseconds without a unit)")

    own = command("cluster", "clusters the bursts of a log and writes all results")
    defined(own)
    own.add_argument("-m", "--most", type=int, help="cluster a sample of so many bursts, and classify the rest")
    own.add_argument("-s", "--sequences", action="store_true", help="align the threads and score the clusters")
    own.add_argument("-r", "--refine", choices=["aggregative", "divisive"], help="refine over levels of eps")
    own.add_argument("--eps", help="least, most and number of the levels, by comma")
    own.add_argument("--min-points", type=int, default=10)
    own.add_argument("--annotate", action="store_true", help="write the log with cluster events")
    own.add_argument("--only-events", action="store_true")
    own.add_argument("--hide-filtered", action="store_true")
    defined(command("extract", "writes the bursts of a log with their metrics"))
    own = command("kdist", "distances to the k-th neighbours")
    defined(own)
    own.add_argument("-k", "--neighbours", default="4,4", help="first and last k, by comma")
    own = sub.add_parser("diff", help="distance of two clusterings of the same bursts, from burst CSV")
    own.add_argument("-1", "--first", required=True)
    own.add_argument("-2", "--second", required=True)
    own = command("score", "sequence scores of a clustering, from burst CSV")
    return top


def burst_csv(spark: SparkSession, path: str) -> DataFrame:
    """Valid rows of a burst CSV as the analysis has them, ids without the files' offset."""
    lines = trace_text.read(spark, path).select(F.col("line").alias("line_id"), F.lit(1).cast("long").alias("trace_id"), F.lit(path).alias("file_name"), F.col("line").cast("int").alias("line_no"), F.col("value").alias("record"))
    rows = parse_burst_lines(lines).where("reason is null")
    return rows.select("instance", "task_id", "thread_id", "begin_time", "end_time", "duration", "line", (F.col("cluster_id") - sinks.FILE_OFFSET).alias("cluster_id"), "metrics", F.lit(0).alias("burst_type"))


def _analysis(spark: SparkSession, a: argparse.Namespace) -> tuple[Analysis, DataFrame, DataFrame, DataFrame | None]:
    run = Analysis.from_xml(a.definition)
    if a.least_duration:
        run.definition.duration_filter = nanoseconds(a.least_duration)
    lines = trace_text.read(spark, a.input)
    labels = formats.labels(trace_text.read(spark, a.labels)).where("kind = 'type'").select("event_type", "label") if a.labels else None
    first = lines.where("line = 1").first()
    if formats.sniff(first["value"] if first else "") == "simulator":
        bursts = run.from_simulator(lines)
    else:
        bursts = run.extract(lines, [int(x) for x in a.events.split(",")] if a.events else None, a.consecutive)
    return run, lines, run.prepare(bursts, labels), labels


def _csv(run: Analysis, bursts: DataFrame, path: str, scope: str = "all") -> None:
    raw, extra = [m.name for m in run.metrics], [f"x_{m.name}" for m in run.extrapolated]
    ratios = [m.name for m in [*run.metrics, *run.extrapolated] if m.operation == "/"]
    own = bursts if "cluster_id" in bursts.columns else bursts.withColumn("cluster_id", F.lit(None).cast("int"))
    rows = sinks.burst_csv_rows(own, raw, run.dims, extra, [*ratios, *(f"x_{r}" for r in ratios)], scope=scope)
    head = sinks.burst_csv_header(raw, raw, [m.name for m in run.extrapolated])
    sinks.write_lines(rows.unionByName(bursts.sparkSession.createDataFrame([(-1, head)], "instance long, value string")), "instance", path)


def _scores(run: Analysis, found: DataFrame, out: str) -> None:
    sinks.scores_csv(run.score(found)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/scores")
    sequence_lines(run._aligned(found, "trace_id")[2]).write.mode("overwrite").csv(f"{out}/sequences", sep=";")


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    if a.command == "diff":
        one, two = (burst_csv(spark, p).select("instance", "cluster_id") for p in (a.first, a.second))
        print(compare.mirkin(one, two).first()["distance"])
        return 0
    if a.command == "score":
        found = burst_csv(spark, a.input)
        from quillon import config

        _scores(Analysis(config.Pipeline()), found, a.output)
        return 0
    run, lines, bursts, labels = _analysis(spark, a)
    if a.command == "extract":
        _csv(run, bursts, f"{a.output}/bursts")
    elif a.command == "kdist":
        first, last = (int(x) for x in a.neighbours.split(","))
        sinks.kdist_rows(run.kdist(bursts, first, last)).write.mode("overwrite").partitionBy("k").text(f"{a.output}/kdist")
    else:
        if a.refine:
            from quillon.operators.refine import eps_ladder

            least, most, steps = a.eps.split(",")
            labelled, nodes = run.refine(bursts, eps_ladder(float(least), float(most), int(steps), a.refine == "aggregative"), a.min_points, a.refine == "divisive")
            found = bursts.join(labelled.withColumnRenamed("id", "instance"), "instance", "left")
            sinks.write_lines(spark.createDataFrame([(i, t) for i, t in enumerate(sinks.tree_dot(nodes).split("\n"))], "i int, value string"), "i", f"{a.output}/tree")
        else:
            found = run.cluster(bursts, a.most)
        _csv(run, found, f"{a.output}/bursts")
        stats = run.stats(found)
        names = [c for c in stats.columns if c not in ("cluster_id", "var_duration")]
        long_form(stats.where("cluster_id is not null"), "cluster_id", names).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.output}/clusters_info")
        clusters = sorted(r[0] for r in found.where("cluster_id is not null").select("cluster_id").distinct().collect())  # one row per cluster
        columns = ["instance", "task_id", "thread_id", "begin_time", "end_time", "duration", "line", *[m.name for m in run.metrics], *run.dims, *[m.name for m in run.extrapolated], "cluster_id"]
        for i, p in enumerate(run.definition.plots):
            if {p.x, p.y} <= set(columns):
                sinks.write_lines(spark.createDataFrame([(0, sinks.plot_script(f"{a.output}/bursts", p.x, p.y, clusters, columns, p.z if p.z in columns else None))], "i int, value string"), "i", f"{a.output}/plot{i}")
        sinks.write_lines(spark.createDataFrame([(0, sinks.label_block(clusters))], "i int, value string"), "i", f"{a.output}/labels")
        if a.sequences:
            _scores(run, found, a.output)
        if a.annotate:
            sinks.write_lines(run.annotate(lines, found, a.only_events, a.hide_filtered), "ts", f"{a.output}/log")
    print(Path(a.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
