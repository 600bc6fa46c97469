"""Other inputs: format sniffing, the simulator's burst records, label files, and the columnar burst store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How the formats begin; a log begins with # and its name.
MAGIC = {"SDDFA;;": "simulator", "# Instan": "bursts"}


def sniff(start: str) -> str:
    """The format of a text by its first 8 characters."""
    for magic, name in MAGIC.items():
        if start.startswith(magic):
            return name
    return "trace" if start[:1] == "#" and start[1:2].isalpha() else "unknown"


def simulator_bursts(lines: DataFrame) -> DataFrame:
    """CPU bursts of simulator records: (task, thread, line, duration in ns, counters).

    Records are ``"CPU burst" { task, thread, seconds };;``, ``"user event" { task, thread, type, value };;``,
    block records and communication records. The first value of a type wins; a burst ends with the next record
    of its task and thread that is no event; bursts inside an idle block are dropped.
    """
    text = F.col("value")
    kind = F.regexp_extract(text, r'^"([^"]+)"', 1)
    args = F.split(F.regexp_extract(text, r"\{\s*([^}]*?)\s*\}", 1), r"\s*,\s*")
    recs = lines.select("line", F.lower(kind).alias("kind"), args.alias("args")).where("kind <> ''")
    recs = recs.withColumn("task", F.get("args", F.lit(0)).try_cast("long")).withColumn("thread", F.get("args", F.lit(1)).try_cast("long"))
    own = Window.partitionBy("task", "thread").orderBy("line")
    block = F.when(F.col("kind") == "block begin", F.get("args", F.lit(2)).try_cast("int")).when(F.col("kind") == "block end", 0)
    seen = recs.withColumn("_block", F.last(block, ignorenulls=True).over(own))
    seen = seen.withColumn("_burst", F.sum(F.when(F.col("kind") != "user event", 1).otherwise(0)).over(own))
    group = Window.partitionBy("task", "thread", "_burst")
    seen = seen.withColumn("_start", F.max(F.when(F.col("kind") == "cpu burst", F.col("line"))).over(group))
    bursts = seen.where((F.col("kind") == "cpu burst") & (F.coalesce("_block", F.lit(0)) == 0)).select(
        "task", "thread", "line", F.round(F.get("args", F.lit(2)).try_cast("double") * 10**9).cast("long").alias("duration"))
    counters = seen.where((F.col("kind") == "user event") & F.col("_start").isNotNull()).groupBy("task", "thread", F.col("_start").alias("line"), F.get("args", F.lit(2)).try_cast("long").alias("t")).agg(
        F.min_by(F.get("args", F.lit(3)).try_cast("long"), "line").alias("v"))
    maps = counters.groupBy("task", "thread", "line").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "v")))).alias("counters"))
    return bursts.join(maps, ["task", "thread", "line"], "left")


def labels(lines: DataFrame) -> DataFrame:
    """(kind, event_type, value, label) of a label file: type rows have a null value.

    Sections begin with EVENT_TYPE (rows ``gradient code label``), VALUES (rows ``value label``) or STATES; a
    blank line ends one. Values belong to every type of the block before them.
    """
    own = Window.orderBy("line")  # a label file is a small dimension
    line = F.trim("value")
    head = F.when(line == "EVENT_TYPE", "type").when(line == "VALUES", "value").when(line == "STATES", "state").when((line == "") | line.rlike("^[A-Z_]+$"), "none")
    marked = lines.withColumn("_head", head).withColumn("_section", F.last("_head", ignorenulls=True).over(own))
    marked = marked.withColumn("_block", F.sum(F.when(F.col("_head") == "type", 1).otherwise(0)).over(own)).where("_head is null")
    types = marked.where("_section = 'type'").select("_block", F.regexp_extract(line, r"^\d+\s+(\d+)\s+(.*)$", 1).try_cast("long").alias("event_type"), F.regexp_extract(line, r"^\d+\s+(\d+)\s+(.*)$", 2).alias("label"))
    pair = lambda s, i: F.regexp_extract(line, r"^(\d+)\s+(.*)$", i)
    values = marked.where("_section = 'value'").select("_block", pair("v", 1).try_cast("long").alias("number"), pair("v", 2).alias("label"))
    state = marked.where("_section = 'state'").select(F.lit("state").alias("kind"), F.lit(None).cast("long").alias("event_type"), pair("s", 1).try_cast("long").alias("number"), pair("s", 2).alias("label"))
    typed = types.select(F.lit("type").alias("kind"), "event_type", F.lit(None).cast("long").alias("number"), "label")
    valued = types.select("_block", "event_type").join(values, "_block").select(F.lit("value").alias("kind"), "event_type", "number", "label")
    return typed.unionByName(valued).unionByName(state)


class BurstStore:
    """Bursts kept as a columnar table, sorted by instance, with a view of the complete ones."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def load(self, bursts: DataFrame) -> None:
        bursts.repartitionByRange("instance").sortWithinPartitions("instance").write.mode("overwrite").parquet(self.path)

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def complete(self) -> DataFrame:
        return self.all().where("burst_type = 0")

    def fetch(self, instance: int) -> DataFrame:
        return self.all().where(F.col("instance") == instance)
