"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.clusters import clusters, typical
from quillon.llm.languages import segments, undenoted
from quillon.llm.packing import pack
from quillon.llm.sequences import frequent_subsequences
from quillon.llm.tokens import encode
from quillon.runtime import dim_join, table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments(table(spark, folder, "documents"), table(spark, folder, "lang_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return undenoted(_segments(spark, folder))


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each document."""
    return _segments(spark, folder).select("doc_id", "denoted", "lang", F.round("confidence", 4).alias("confidence"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of each paragraph of prose."""
    return _segments(spark, folder).select("doc_id", F.inline("segments")).select("doc_id", "segment", "lang", F.round("confidence", 4).alias("confidence"), "chars")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_subsequences(table(spark, folder, "bursts")).select("trace_id", "pattern")


def p2_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent patterns with the number of sequences that contain them."""
    return frequent_subsequences(table(spark, folder, "bursts"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, _, isolated = clusters(table(spark, folder, "bursts"), table(spark, folder, "burst_events"))
    return dim_join(members, isolated.select("cluster", F.col("first").alias("group_first")), ["cluster"]).select("instance", "group_first")


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster of similar bursts with its size, medians and most typical instances."""
    members, stats, _ = clusters(table(spark, folder, "bursts"), table(spark, folder, "burst_events"))
    return typical(members, stats)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """container, doc_id, start, length and place of every piece of text."""
    return pack(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_patterns, p3_found, p3_clusters, p6_ids, p7_containers, p8_found, p8_documents, p8_segments)}
_PATTERNS = """
WITH d AS (SELECT instance, max(trace_id) AS trace_id, max(task_id) AS task_id, max(thread_id) AS thread_id, max(begin_time) AS t, max(cluster_id) AS c FROM bursts GROUP BY instance),
s AS (SELECT trace_id, task_id, thread_id, c, row_number() OVER (PARTITION BY trace_id, task_id, thread_id ORDER BY t, instance) AS k FROM d WHERE c >= 6),
n AS (SELECT trace_id, count(DISTINCT (task_id, thread_id)) AS n FROM s GROUP BY trace_id),
a AS (SELECT x.trace_id, x.task_id, x.thread_id, x.c || '-' || y.c AS p, y.k FROM s x JOIN s y USING (trace_id, task_id, thread_id) WHERE y.k - x.k BETWEEN 1 AND 3),
b AS (SELECT DISTINCT trace_id, task_id, thread_id, a.p || '-' || y.c AS p, y.k FROM a JOIN s y USING (trace_id, task_id, thread_id) WHERE y.k - a.k BETWEEN 1 AND 3),
e AS (SELECT DISTINCT trace_id, task_id, thread_id, b.p || '-' || y.c AS p, y.k FROM b JOIN s y USING (trace_id, task_id, thread_id) WHERE y.k - b.k BETWEEN 1 AND 3),
u AS (SELECT DISTINCT trace_id, task_id, thread_id, p FROM (SELECT * FROM b UNION ALL SELECT * FROM e)),
r AS (SELECT trace_id, p AS pattern, count(*) AS support FROM u GROUP BY ALL)
"""
SQL: dict[str, str] = {
    "p2_found": _PATTERNS + "SELECT trace_id, pattern FROM r JOIN n USING (trace_id) WHERE support * 10 >= n * 6",
    "p2_patterns": _PATTERNS + "SELECT trace_id, pattern, support FROM r JOIN n USING (trace_id) WHERE support * 10 >= n * 6",
}
