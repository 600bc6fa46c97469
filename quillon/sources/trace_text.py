"""The text log: records, header, communicators and metadata, and records back to text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.model import COMM_FIELDS, EVENT_FIELDS, GLOBALOP_FIELDS, STATE_FIELDS

STATE, EVENT, COMM, GLOBALOP = 1, 2, 3, 4


def records(lines: DataFrame, kinds: Sequence[int] = (STATE, EVENT, COMM, GLOBALOP), tasks: Sequence[int] | None = None) -> DataFrame:
    """(line, kind, fields) of record lines of the given kinds (and tasks, 0-based); headers and comments are skipped.

    ``lines`` has line and value. The leading digit is tested before a line is split.
    """
    kind = F.regexp_extract("value", r"^\s*([1-4]):", 1)
    hit = lines.where(kind.isin(*[str(k) for k in kinds]))
    split = hit.select("line", kind.try_cast("int").alias("kind"), F.split(F.regexp_replace("value", r"\s", ""), ":").alias("fields"))
    if tasks is None:
        return split
    return split.where(F.get("fields", F.lit(3)).try_cast("long").isin(*[t + 1 for t in tasks]))


def _typed(names: Sequence[str], offset: int = 1) -> list[Column]:
    return [F.get("fields", F.lit(i + offset)).try_cast("long").alias(n) for i, n in enumerate(names)]


def malformed(recs: DataFrame) -> DataFrame:
    """Records with a wrong number of fields or a field that is no integer."""
    widths = {STATE: len(STATE_FIELDS), COMM: len(COMM_FIELDS), GLOBALOP: len(GLOBALOP_FIELDS)}
    size = F.size("fields") - 1
    bad = (F.col("kind") == EVENT) & ((size < len(EVENT_FIELDS) + 2) | ((size - len(EVENT_FIELDS)) % 2 != 0))
    for k, n in widths.items():
        bad |= (F.col("kind") == k) & (size != n)
    return recs.where(bad | F.exists("fields", lambda x: x.try_cast("long").isNull()))


def _ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ids count from 1 in the text and from 0 in tables."""
    return df.withColumns({c: F.col(c) - 1 for c in columns})


def states(recs: DataFrame) -> DataFrame:
    """S2."""
    return _ids(recs.where(F.col("kind") == STATE).select("line", *_typed(STATE_FIELDS)), ["task", "thread"])


def events(recs: DataFrame) -> DataFrame:
    """S3: one row per (type, value) pair, with its ordinal in the record; an unpaired tail is left out."""
    size = F.size("fields") - 1 - len(EVENT_FIELDS)
    first = 1 + len(EVENT_FIELDS)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(size / 2).cast("int") - 1), lambda i: F.struct(
        F.get("fields", first + 2 * i).try_cast("long").alias("event_type"), F.get("fields", first + 2 * i + 1).try_cast("long").alias("event_value")))
    own = recs.where((F.col("kind") == EVENT) & (F.size("fields") >= first + 2))
    long = own.select("line", *_typed(EVENT_FIELDS), F.posexplode(pairs).alias("ordinal", "_pair"))
    return _ids(long.select("line", *EVENT_FIELDS, "ordinal", "_pair.event_type", "_pair.event_value"), ["task", "thread"])


def communications(recs: DataFrame) -> DataFrame:
    """S4."""
    return _ids(recs.where(F.col("kind") == COMM).select("line", *_typed(COMM_FIELDS)), ["src_task", "src_thread", "dst_task", "dst_thread"])


def global_operations(recs: DataFrame) -> DataFrame:
    """S5."""
    return _ids(recs.where(F.col("kind") == GLOBALOP).select("line", *_typed(GLOBALOP_FIELDS)), ["task", "thread"])


@dataclass
class Header:
    """Date, final time, factor to ns, resources, and per application its tasks as (threads, node)."""

    date: str
    final_time: int
    time_factor: int
    resources: str
    applications: list[list[tuple[int, int]]] = field(default_factory=list)


def header(line: str) -> Header:
    """A first line ``#<name> (date):time[_ns]:resources:n:apps`` with apps ``tasks(threads:node,...)``; only one application is accepted."""
    found = re.match(r"#\w+ \(([^)]*)\):(\d+)(_ns)?:([^:]*):(\d+)(?::(.*))?$", line.strip())
    if not found:
        raise ValueError("not a trace header")
    apps = []
    for part in re.finditer(r"(\d+)\(([^)]*)\)", found[6] or ""):
        tasks = [tuple(int(x) for x in t.split(":")) for t in part[2].split(",") if t]
        if len(tasks) != int(part[1]):
            raise ValueError("task list and count differ")
        apps.append([(t[0], t[1] if len(t) > 1 else 0) for t in tasks])
    if len(apps) > 1 or int(found[5]) > 1:
        raise ValueError("only one application is supported")
    return Header(found[1], int(found[2]), 1 if found[3] else 1000, found[4], apps)


def communicators(lines: DataFrame) -> DataFrame:
    """(app, id, size, tasks) from lines ``c:app:id:size:task:...``."""
    f = F.split("value", ":")
    own = lines.where(F.col("value").startswith("c:"))
    return own.select("line", F.get(f, F.lit(1)).try_cast("int").alias("app"), F.get(f, F.lit(2)).try_cast("int").alias("id"), F.get(f, F.lit(3)).try_cast("int").alias("size"),
                      F.transform(F.slice(f, 5, F.greatest(F.size(f) - 4, F.lit(0))), lambda x: x.try_cast("long") - 1).alias("tasks"))


def metadata(lines: DataFrame) -> DataFrame:
    """Comment lines ``#date:action:application:trace[:offset:begin:end]``, newest first."""
    f = F.split(F.substring("value", 2, 1 << 20), ":")
    own = lines.where(F.col("value").startswith("#") & (F.col("line") > 1))
    return own.select("line", F.get(f, F.lit(0)).alias("date"), F.get(f, F.lit(1)).alias("action"), F.get(f, F.lit(2)).alias("application"), F.get(f, F.lit(3)).alias("trace"),
                      *[F.get(f, F.lit(4 + i)).try_cast("long").alias(n) for i, n in enumerate(("offset", "begin", "end"))]).orderBy(F.desc("line"))


# ---------------------------------------------------------------- back to text


def _text(kind: int, columns: Sequence[Column | str]) -> Column:
    return F.concat_ws(":", F.lit(str(kind)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def state_lines(df: DataFrame) -> Column:
    return _text(STATE, ["cpu", "app", F.col("task") + 1, F.col("thread") + 1, "begin", "end", "state"])


def event_lines(pairs: str = "pairs") -> Column:
    """Of a row with ``pairs``, an array of (event_type, event_value)."""
    flat = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["event_type"], p["event_value"])), ":")
    return _text(EVENT, ["cpu", "app", F.col("task") + 1, F.col("thread") + 1, "ts", flat])


def comm_lines() -> Column:
    return _text(COMM, [F.col(c) + 1 if c.endswith(("_task", "_thread")) else c for c in COMM_FIELDS])


def globalop_lines() -> Column:
    return _text(GLOBALOP, [F.col(c) + 1 if c in ("task", "thread") else c for c in GLOBALOP_FIELDS])


def numbered(lines: DataFrame, order: str) -> DataFrame:
    """(line, value) of text rows in an order; numbered by range partitions."""
    from quillon.operators.ranks import ranked

    return ranked(lines.select(order, "value"), [], [order]).select(F.col("_rank").alias("line"), "value")


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(line, value) of a log file or folder; lines are numbered in file order."""
    raw = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("_at"))
    return numbered(raw, "_at")
