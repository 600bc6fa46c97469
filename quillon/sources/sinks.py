"""Outputs: burst tables, statistics, plots, annotated logs, sequences, trees and hulls as text rows or files."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import CLUSTER_EVENT, FILE_OFFSET, MISSING_DATA
from quillon.operators.assembly import as_of, by_line
from quillon.sources.trace_text import event_lines

#: Colours of clusters in label files and plots, repeated in turn.
PALETTE = ["808080", "1f77b4", "ff7f0e", "2ca02c", "d62728", "9467bd", "8c564b", "e377c2", "bcbd22", "17becf"]


def number(c: str, decimals: int) -> Column:
    """A number with fixed decimals; nan if missing."""
    return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), "nan").otherwise(F.format_string(f"%.{decimals}f", F.col(c).cast("double")))


def burst_csv_rows(bursts: DataFrame, raw: Sequence[str], normal: Sequence[str], extra: Sequence[str], ratios: Sequence[str] = (), offset: int = FILE_OFFSET, scope: str = "all") -> DataFrame:
    """K1: (instance, value): CSV rows of bursts without those of missing data; ratio metrics have 6 decimals, others none.

    The ``scope`` is all of them, the "complete" ones, or those a "clustering" has given an id.
    """
    keys = ["instance", "task_id", "thread_id", "begin_time", "end_time", "duration", "line"]
    shown = [F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys]
    shown += [number(c, 6 if c in ratios else 0) for c in raw] + [number(c, 6) for c in normal] + [number(c, 6 if c in ratios else 0) for c in extra]
    within = {"all": F.col("burst_type") != MISSING_DATA, "complete": F.col("burst_type") == 0, "clustering": (F.col("burst_type") == 0) & F.col("cluster_id").isNotNull()}
    rows = bursts.where(within[scope])
    return rows.select("instance", F.concat_ws(",", *shown, (F.coalesce("cluster_id", F.lit(0)) + offset).cast("string")).alias("value"))


def burst_csv_header(raw: Sequence[str], normal: Sequence[str], extra: Sequence[str]) -> str:
    return "# " + ",".join(["Instance", "TaskId", "ThreadId", "Begin_Time", "End_Time", "Duration", "Line", *[f"d_{c}" for c in raw], *[f"n_{c}" for c in normal], *[f"x_{c}" for c in extra], "ClusterID"])


def write_lines(rows: DataFrame, order: str, path: str) -> None:
    """Text rows in order, as one part per range; a reader takes the parts in name order."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def concat_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """The shards' rows under the columns of the first."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s.select(*out.columns))
    return out


def scores_csv(scores: DataFrame) -> DataFrame:
    """Cluster scores with a GLOBAL row: all occurrences and the sum of weighted scores."""
    rows = scores.select(F.when(F.col("cluster_id") == 0, "NOISE").otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id"))).alias("cluster"), "score", "occurrences", "weighted")
    total = scores.agg(F.sum("weighted").alias("weighted"), F.sum("occurrences").alias("occurrences")).select(F.lit("GLOBAL").alias("cluster"), F.col("weighted").alias("score"), "occurrences", "weighted")
    return rows.unionByName(total)


def plot_script(data: str, x: str, y: str, clusters: Sequence[int], columns: Sequence[str], z: str | None = None, title: str = "") -> str:
    """K3: a scatter plot script with one series per cluster."""
    at = {c: i + 1 for i, c in enumerate(columns)}
    own = at["cluster_id"]
    axes = f"set xlabel '{x}'\nset ylabel '{y}'\n" + (f"set zlabel '{z}'\n" if z else "")
    series = []
    for c in clusters:
        use = f"{at[x]}:"
        value = f"(${own} == {c + FILE_OFFSET} ? ${at[y]} : 1/0)" + (f":{at[z]}" if z else "")
        name = "NOISE" if c == 0 else f"Cluster {c}"
        series.append(f"'{data}' using {use}{value} title '{name}' lc rgb '#{PALETTE[c % len(PALETTE)]}'")
    return f"set datafile separator ','\nset title '{title}'\n{axes}{'splot' if z else 'plot'} " + ", \\\n  ".join(series) + "\n"


def all_plots(metrics: Sequence[str], extra: Sequence[str] = ()) -> list[tuple[str, ...]]:
    """K3: all pairs of metrics, and each pair with every extrapolated metric and the duration."""
    pairs = list(combinations(metrics, 2))
    return [*pairs, *[(*p, e) for p in pairs for e in [*extra, "duration"]]]


def hull_plot(points: Sequence[tuple[float, float]], cluster: int) -> str:
    """A closed curve of a hull."""
    return "\n".join(f"{x:.9g} {y:.9g} {cluster}" for x, y in [*points, *points[:1]])


def annotations(bursts: DataFrame, hide_filtered: bool = False) -> DataFrame:
    """K4, K6: cluster events of bursts, from running states or semantic regions: id + offset at the begin, 0 at the end; where one burst ends as the next begins, close comes before open in one record.

    Rows (task, thread, ts, pairs). The offset is added once.
    """
    own = bursts.where(F.col("burst_type") == 0) if hide_filtered else bursts
    marks = own.where(F.col("end_time").isNotNull()).select("task_id", "thread_id", F.explode(F.array(
        F.struct(F.col("begin_time").alias("ts"), F.lit(1).alias("o"), (F.coalesce("cluster_id", F.lit(0)) + FILE_OFFSET).cast("long").alias("v")),
        F.struct(F.col("end_time").alias("ts"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("v")))).alias("m"))
    grouped = marks.groupBy(F.col("task_id").alias("task"), F.col("thread_id").alias("thread"), F.col("m.ts").alias("ts")).agg(F.sort_array(F.collect_list(F.struct("m.o", "m.v"))).alias("m"))
    pairs = F.transform("m", lambda x: F.struct(F.lit(CLUSTER_EVENT).cast("long").alias("event_type"), x["v"].alias("event_value")))
    return grouped.select("task", "thread", "ts", pairs.alias("pairs"))


def annotated(lines: DataFrame, marks: DataFrame, only_events: bool = False) -> DataFrame:
    """The log's lines and the cluster events, in time order; ``lines`` has ts, line and value."""
    events = marks.select("ts", F.lit(-1).cast("long").alias("line"), event_lines().alias("value")) if "cpu" in marks.columns else marks.withColumns(
        {"cpu": F.lit(0), "app": F.lit(1)}).select("ts", F.lit(-1).cast("long").alias("line"), event_lines().alias("value"))
    return (events if only_events else lines.select("ts", "line", "value").unionByName(events)).orderBy("ts", "line", "value")


def annotated_events(lines: DataFrame, bursts: DataFrame) -> DataFrame:
    """K5: (line, part, value): the log with a cluster event after the record that opens a region, and a 0 where it ends.

    Regions are found by the line of their opening record (J10); the 0 stands in the record of the opening event if the
    next region of the thread begins as one ends, else in one of its own, which is given the line of the last record
    before it in time. ``lines`` has line and value.
    """
    field = lambda i: F.get(F.split("value", ":"), F.lit(i)).try_cast("long")
    opened = by_line(bursts.select("line", "cluster_id"), lines.where(F.col("value").startswith("2:"))).where(F.col("cluster_id").isNotNull())
    head = F.substring_index("value", ":", 6)
    begins = opened.select("line", F.lit(1).alias("part"), (field(3) - 1).alias("task"), (field(4) - 1).alias("thread"), field(5).alias("ts"), head.alias("head"), (F.col("cluster_id") + FILE_OFFSET).cast("long").alias("v"))
    ends = bursts.where(F.col("end_time").isNotNull()).select(F.col("task_id").alias("task"), F.col("thread_id").alias("thread"), F.col("end_time").alias("ts"))
    closed = begins.join(ends.distinct().withColumn("_closes", F.lit(True)), ["task", "thread", "ts"], "left")
    event = lambda v: F.concat_ws(":", F.lit(str(CLUSTER_EVENT)), v)
    opening = closed.select("line", "part", F.concat_ws(":", "head", F.when(F.col("_closes"), event(F.lit("0"))), event(F.col("v"))).alias("value"))
    alone = ends.distinct().join(begins.select("task", "thread", "ts"), ["task", "thread", "ts"], "left_anti")
    timed = lines.where(F.col("value").rlike("^[1-4]:")).select((field(3) - 1).alias("task"), (field(4) - 1).alias("thread"), field(5).alias("_at"), "line")
    placed = as_of(alone.withColumn("ts", F.col("ts") + 1), timed, ["task", "thread"], begin="_at", payload=("line",), tie="line")
    closing = placed.select(F.coalesce("line", F.lit(0)).alias("line"), F.lit(2).alias("part"), F.concat_ws(":", F.lit("2:0:1"), F.col("task") + 1, F.col("thread") + 1, F.col("ts") - 1, event(F.lit("0"))).alias("value"))
    return lines.select("line", F.lit(0).alias("part"), "value").unionByName(opening).unionByName(closing)


def user_event(task: Column, thread: Column, kind: Column, value: Column) -> Column:
    """A user event of the simulator's records."""
    return F.format_string('"user event" { %d, %d, %d, %d };;', task, thread, kind, value)


def block(edge: str, task: Column, thread: Column, number: Column) -> Column:
    """X9: "begin" or "end" of a block."""
    return F.format_string(f'"block {edge}" {{ %d, %d, %d }};;', task, thread, number)


def cpu_burst(task: Column, thread: Column, nanoseconds: Column) -> Column:
    """A burst; the simulator counts in seconds, here to the microsecond, halves up."""
    micros = F.floor((nanoseconds + 500) / 1000).cast("long")
    return F.format_string('"CPU burst" { %d, %d, %d.%06d };;', task, thread, F.floor(micros / 10**6).cast("long"), F.pmod(micros, F.lit(10**6)))


def annotated_simulator(lines: DataFrame, bursts: DataFrame, blocks: bool = False, replace: bool = False) -> DataFrame:
    """K7: (line, part, value): the simulator's records with cluster events, and ``blocks``, around each burst's record.

    The offset is added to the id once. With ``replace`` the id stands for the duration. Other records stay as they are.
    """
    known = by_line(bursts.select("line", "task_id", "thread_id", "duration", "cluster_id"), lines, ["task_id", "thread_id", "duration", "cluster_id"])
    task, thread, number = F.col("task_id"), F.col("thread_id"), (F.coalesce("cluster_id", F.lit(0)) + FILE_OFFSET).cast("long")
    burst = F.format_string('"CPU burst" { %d, %d, %d };;', task, thread, number) if replace else cpu_burst(task, thread, F.col("duration"))
    parts = [user_event(task, thread, F.lit(CLUSTER_EVENT), number), *([block("begin", task, thread, number)] if blocks else []), burst, *([block("end", task, thread, number)] if blocks else []), user_event(task, thread, F.lit(CLUSTER_EVENT), F.lit(0))]
    return known.select("line", F.posexplode(F.when(task.isNull(), F.array("value")).otherwise(F.array(*parts))).alias("part", "value"))


def label_block(clusters: Sequence[int]) -> str:
    """K8: the cluster event type with its values, to append to a label file."""
    rows = [f"{c + FILE_OFFSET}   {'Noise' if c == 0 else f'Cluster {c}'}" for c in clusters]
    colours = [f"{i}    {{{','.join(str(int(p[j:j + 2], 16)) for j in (0, 2, 4))}}}" for i, p in enumerate(PALETTE)]
    return "\n".join(["EVENT_TYPE", f"9    {CLUSTER_EVENT}    Cluster ID", "VALUES", "0   End", *rows, "", "GRADIENT_COLOR", *colours, ""])


def tree_dot(nodes: Sequence, name: str = "refinement") -> str:
    """The refinement tree with one rank per level."""
    key = lambda n: f"n{n.level}_{n.id}"
    out = [f"digraph {name} {{"]
    for n in nodes:
        out.append(f'  {key(n)} [label="{n.id}\\nscore {n.score:.2f}\\nrows {n.rows}"];')
    for level in sorted({n.level for n in nodes}):
        out.append("  {rank=same; " + " ".join(key(n) + ";" for n in nodes if n.level == level) + "}")
    latest = {}
    for n in sorted(nodes, key=lambda n: n.level):
        for p in n.parents:
            if p in latest and latest[p] != key(n):
                out.append(f"  {latest[p]} -> {key(n)};")
        latest[n.id] = key(n)
    return "\n".join([*out, "}"])


def kdist_rows(distances: DataFrame) -> DataFrame:
    """Per k the distances, largest first, with 6 decimals; write with partitionBy('k')."""
    return distances.select("k", "dist", "id", F.format_string("%.6f", "dist").alias("value")).repartitionByRange("k", F.desc("dist"), "id").sortWithinPartitions("k", F.desc("dist"), "id").select("k", "value")


def hull_rows(model: DataFrame) -> DataFrame:
    """Corners of hulls, x, y and id, with 9 digits."""
    return model.select("cluster_id", F.posexplode("points").alias("place", "p")).select("cluster_id", "place", F.format_string("%.9g, %.9g, %d", "p.x", "p.y", "cluster_id").alias("value"))


def support_rows(cells: DataFrame) -> DataFrame:
    """Each cell's centre as often as it was hit."""
    return cells.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("support").cast("int")))).select((F.col("cell_x") + 0.5).alias("x"), (F.col("cell_y") + 0.5).alias("y"))


def latest_only(marks: DataFrame, given: str = "given") -> DataFrame:
    """Marks of the same thread and time once, the last given; ``given`` is a column in the order they came."""
    own = Window.partitionBy("task", "thread", "ts").orderBy(F.desc(given))
    return marks.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
