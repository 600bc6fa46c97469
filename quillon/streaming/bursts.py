"""Live input: totals per micro-batch, windows with late data, and bursts assembled with per-thread state."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.runtime import new_path

RECORDS = "task long, thread long, kind string, ts long, end long, line long, event_type long, event_value long"
BURSTS = "task long, thread long, begin long, end long, line long, event_type long, total long"
STATE = "open string"


def totals(stream: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """Aggregates of a stream folded per micro-batch into partial rows, merged when read.

    A batch overwrites its own folder, so a batch that runs again after a failure counts once.
    """
    spark = stream.sparkSession
    out, mark = new_path(spark, "partials"), new_path(spark, "offsets")

    def fold(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(stream.writeStream.foreachBatch(fold).option("checkpointLocation", mark))
    return spark.read.parquet(out).groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def _drain(writer) -> None:  # noqa: ANN001
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def windows(stream: DataFrame, ts: str, keys: Sequence[str], width: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling windows over event time with a watermark; the last state of each window is kept."""
    spark = stream.sparkSession
    out, mark = new_path(spark, "windows"), new_path(spark, "offsets")
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(grouped.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark))
    seen = spark.read.parquet(out)
    names = list(aggregates)
    last = seen.groupBy(F.col("window.start").alias("start"), *keys).agg(F.max_by(F.struct(*names), "batch").alias("_v"))
    return last.select("start", *keys, *[F.col(f"_v.{n}").alias(n) for n in names])


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One thread: its open burst and counters are state; an event belongs to begin < ts <= end."""
    now = json.loads(state.get[0]) if state.exists else None
    out: list[tuple] = []

    def close() -> None:
        if now:
            out.extend((*key, now["begin"], now["end"], now["line"], int(t), v) for t, v in sorted(now["sums"].items(), key=lambda x: int(x[0])))
            if not now["sums"]:
                out.append((*key, now["begin"], now["end"], now["line"], None, None))

    if state.hasTimedOut:
        close()
        state.remove()
    else:
        rows = pd.concat(list(frames), ignore_index=True)
        rows["_rank"] = (rows["kind"] == "state").astype(int)
        for r in rows.sort_values(["ts", "_rank", "line"]).itertuples(index=False):
            if r.kind == "state":
                if now and r.ts < now["end"]:
                    continue  # overlapping running states are ignored
                close()
                now = {"begin": int(r.ts), "end": int(r.end), "line": int(r.line), "sums": {}}
            elif now and now["begin"] < r.ts <= now["end"]:
                t = str(int(r.event_type))
                now["sums"][t] = now["sums"].get(t, 0) + int(r.event_value)
        if now:
            state.update((json.dumps(now),))
            state.setTimeoutDuration(1000)
    names = ["task", "thread", "begin", "end", "line", "event_type", "total"]
    yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names})


def assemble(stream: DataFrame) -> DataFrame:
    """J1 over a stream of RECORDS (running states and events in time order per thread): rows of BURSTS.

    State per (task, thread) is one open burst. J7: a thread that is silent for a second gives its open burst.
    """
    return stream.groupBy("task", "thread").applyInPandasWithState(_step, BURSTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files; as a pattern, the path may be a file or a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
