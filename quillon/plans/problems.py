"""Queries of the general problems, with their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.parsing import parse_burst_lines, parse_semantic_lines
from quillon.operators.skew import heavy_keys, ordered_stats, skewed_stats
from quillon.operators.spikes import implausible
from quillon.runtime import table


def p1_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, total duration and mean of d_ipc per cluster id, duplicates included."""
    stats = skewed_stats(table(spark, folder, "bursts"), "cluster_id", ["begin_time", "instance"],
                         {"row_count": F.count(F.lit(1)), "total_duration": F.sum("duration"), "mean_ipc": F.round(F.avg("d_ipc"), 6)})
    return stats


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    stats = skewed_stats(table(spark, folder, "bursts"), "cluster_id", ["begin_time", "instance"], {"row_count": F.count(F.lit(1))})
    return heavy_keys(stats, "cluster_id", "row_count", 0.04).select(F.col("cluster_id").cast("long"))


def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """First and last begin per cluster id and the longest time without a burst of it."""
    return ordered_stats(table(spark, folder, "bursts"), "cluster_id", "begin_time", "instance").select(
        F.col("cluster_id").cast("long"), F.col("rows").alias("row_count"), F.col("first").alias("first_begin"), F.col("last").alias("last_begin"), "largest_step")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    burst = parse_burst_lines(table(spark, folder, "burst_csv_lines"), metrics=False).where(F.col("reason").isNotNull())
    semantic = parse_semantic_lines(table(spark, folder, "semantic_lines")).where(F.col("reason").isNotNull())
    return burst.select(F.lit("burst_csv_lines").alias("raw_table"), "line_id").unionByName(
        semantic.select(F.lit("semantic_lines").alias("raw_table"), "line_id"))


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    burst = parse_burst_lines(table(spark, folder, "burst_csv_lines"), metrics=False).where(F.col("reason").isNotNull())
    semantic = parse_semantic_lines(table(spark, folder, "semantic_lines")).where(F.col("reason").isNotNull())
    return burst.select(F.lit("burst_csv_lines").alias("raw_table"), "line_id", "reason").unionByName(
        semantic.select(F.lit("semantic_lines").alias("raw_table"), "line_id", "reason"))


def p4_bursts(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the valid burst lines; metrics as two arrays in header order of names."""
    rows = parse_burst_lines(table(spark, folder, "burst_csv_lines")).where(F.col("reason").isNull())
    names = F.sort_array(F.map_keys("metrics"))
    return rows.select("line_id", "instance", "task_id", "thread_id", "begin_time", "end_time", "duration", "line", "cluster_id",
                       F.size("metrics").alias("metric_count"), F.array_join(names, ",").alias("metric_names"))


def p4_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of the valid semantic lines."""
    rows = parse_semantic_lines(table(spark, folder, "semantic_lines")).where(F.col("reason").isNull())
    return rows.select("line_id", "application", "task", "thread", "begin_time", "duration", "value")


def _implausible(spark: SparkSession, folder: str) -> DataFrame:
    return implausible(*(table(spark, folder, t) for t in ("bursts", "burst_events", "traces")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _implausible(spark, folder).select("instance", "event_type")


def p5_faults(spark: SparkSession, folder: str) -> DataFrame:
    return _implausible(spark, folder).select("instance", "event_type", "fault", F.round("score", 4).alias("score"))


QUERIES = {f.__name__: f for f in (p1_stats, p1_found, p1_steps, p4_found, p4_reasons, p4_bursts, p4_semantic, p5_found, p5_faults)}

_SEMANTIC = """
WITH s AS (SELECT line_id, regexp_replace(coalesce(record, ''), '\r$', '') AS r FROM semantic_lines),
f AS (SELECT line_id, r, list_transform(string_split(r, chr(9)), lambda x: trim(x, ' ')) AS q FROM s),
u AS (SELECT line_id, r, list_transform(q, lambda x: CASE WHEN regexp_full_match(x, '"([^"]|"")*"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS c,
      len(list_filter(q, lambda x: contains(x, '"') AND NOT regexp_full_match(x, '"([^"]|"")*"'))) AS broken FROM f),
n AS (SELECT *, CASE WHEN len(c) = 4 AND broken = 0 THEN string_split(c[1], '.') END AS o FROM u),
v AS (SELECT *, o IS NOT NULL AND len(o) IN (2, 3) AND len(list_filter(o, lambda x: NOT coalesce(regexp_full_match(x, '[0-9]+') AND TRY_CAST(x AS HUGEINT) BETWEEN 1 AND 4294967295, false))) = 0
      AND regexp_full_match(c[2], '[0-9]+') AND coalesce(TRY_CAST(c[2] AS HUGEINT) < 9223372036854775808, false)
      AND regexp_full_match(c[3], '[0-9]+') AND coalesce(TRY_CAST(c[3] AS HUGEINT) < 9223372036854775808, false)
      AND regexp_full_match(c[4], '[0-9]+') AND coalesce(TRY_CAST(c[4] AS HUGEINT) < 4294967296, false) AS ok FROM n)
"""
# A field is blanks, then a quoted text or one without quotes, then blanks; extracted left to right.
_BURST = """
WITH l AS (SELECT line_id, trace_id, file_name, line_no, regexp_replace(coalesce(record, ''), '\r$', '') AS r FROM burst_csv_lines),
h AS (SELECT trace_id, file_name, arg_min(r, line_no) AS header FROM l GROUP BY ALL),
g AS (SELECT l.line_id, r, list_transform(string_split(ltrim(header, '#'), ','), lambda x: trim(x)) AS names,
      regexp_full_match(r, '[ \t]*("([^"]|"")*"|[^",]*)[ \t]*(,[ \t]*("([^"]|"")*"|[^",]*)[ \t]*)*') AS quoted_well,
      list_transform(regexp_extract_all(r || ',', '([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*),', 1), lambda x: trim(trim(trim(x, ' ' || chr(9)), '"'), '')) AS c
      FROM l JOIN h ON l.trace_id = h.trace_id AND l.file_name = h.file_name WHERE NOT starts_with(r, '#')),
v AS (SELECT line_id, c, names, quoted_well AND trim(r, ' ' || chr(9)) <> '' AND len(c) = len(names)
      AND len(list_filter(c[1:7], lambda x: NOT regexp_full_match(x, '[0-9]+'))) = 0 AND regexp_full_match(c[-1], '[0-9]+')
      AND len(list_filter(c[1:7], lambda x: NOT coalesce(TRY_CAST(x AS HUGEINT) < 9223372036854775808, false))) = 0
      AND coalesce(TRY_CAST(c[2] AS HUGEINT) < 4294967296 AND TRY_CAST(c[3] AS HUGEINT) < 4294967296 AND TRY_CAST(c[-1] AS HUGEINT) < 2147483648, false)
      AND coalesce(TRY_CAST(c[5] AS HUGEINT) >= TRY_CAST(c[4] AS HUGEINT), false)
      AND len(list_filter(c[8:11], lambda x: NOT regexp_full_match(x, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?'))) = 0
      AND len(list_filter(c[12:len(c) - 1], lambda x: NOT regexp_full_match(x, 'nan|[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?'))) = 0 AS ok FROM g)
"""

SQL = {
    "p1_stats": "SELECT cluster_id, count(*) AS row_count, CAST(sum(duration) AS BIGINT) AS total_duration, round(avg(d_ipc), 6) AS mean_ipc FROM bursts GROUP BY cluster_id",
    "p1_found": "SELECT CAST(cluster_id AS BIGINT) AS cluster_id FROM bursts WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(*) >= 0.04 * (SELECT count(cluster_id) FROM bursts)",
    "p1_steps": """SELECT CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS row_count, min(begin_time) AS first_begin, max(begin_time) AS last_begin, max(step) AS largest_step
        FROM (SELECT cluster_id, begin_time, begin_time - lag(begin_time) OVER (PARTITION BY cluster_id ORDER BY begin_time, instance) AS step
              FROM bursts WHERE cluster_id IS NOT NULL AND begin_time IS NOT NULL) GROUP BY cluster_id""",
    "p4_found": f"""SELECT 'burst_csv_lines' AS raw_table, line_id FROM ({_BURST} SELECT * FROM v WHERE NOT ok)
        UNION ALL SELECT 'semantic_lines' AS raw_table, line_id FROM ({_SEMANTIC} SELECT * FROM v WHERE NOT coalesce(ok, false))""",
    "p4_bursts": _BURST + """SELECT line_id, CAST(c[1] AS BIGINT) AS instance, CAST(c[2] AS BIGINT) AS task_id, CAST(c[3] AS BIGINT) AS thread_id, CAST(c[4] AS BIGINT) AS begin_time,
        CAST(c[5] AS BIGINT) AS end_time, CAST(c[6] AS BIGINT) AS duration, CAST(c[7] AS BIGINT) AS line, CAST(c[-1] AS INTEGER) AS cluster_id,
        CAST(len(names) - 8 AS INTEGER) AS metric_count, array_to_string(list_sort(names[8:len(names) - 1]), ',') AS metric_names FROM v WHERE ok""",
    "p4_semantic": _SEMANTIC + """SELECT line_id, CAST(o[1] AS BIGINT) AS application, CAST(o[2] AS BIGINT) AS task, CAST(o[3] AS BIGINT) AS thread,
        CAST(c[2] AS BIGINT) AS begin_time, CAST(c[3] AS BIGINT) AS duration, CAST(c[4] AS BIGINT) AS value FROM v WHERE ok""",
}
