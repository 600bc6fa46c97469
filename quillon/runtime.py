"""Session helpers: the shared folder, lineage cuts, checked broadcasts, salted joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size (bytes) of a side that is broadcast; beyond it a shuffled join is used.
BROADCAST_LIMIT = 8 << 20
_written: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
    return _own_dir[0]


def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    _written.clear()


atexit.register(_remove_written)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a written table or file before the driver ends, where its last reader is known."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [w for w in _written if w[1] != path]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, by the file system that it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Width of a value in memory by type, for values of fixed width; others are taken as WIDE bytes.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8, "date": 4}
WIDE = 64


def estimated_bytes(df: DataFrame) -> int:
    """The larger of Catalyst's size estimate, which for files is that of compressed bytes, and rows times width where it knows rows."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    width = sum(WIDTHS.get(kind, WIDE) for _, kind in df.dtypes)
    packed = sum(8 for _ in df.dtypes)
    rows = int(stats.rowCount().get()) if stats.rowCount().isDefined() else 0
    # compressed columns may hold several times their bytes
    return max(int(stats.sizeInBytes()) * max(1, -(-width // packed)), rows * width)


def dim_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join facts with a dimension: broadcast if its estimated size is below the limit, else salted shuffle.

    In the salted form each dimension row is repeated once per salt, so that a key that holds a third of
    all fact rows is spread over ``salts`` tasks.
    """
    if estimated_bytes(dim) <= BROADCAST_LIMIT:
        return facts.join(F.broadcast(dim), keys, how)
    return salted_join(facts, dim, keys, how, salts)


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Each fact row takes a salt by the hash of its whole content, so that a task that runs again salts alike."""
    plain = [c for c, kind in facts.dtypes if "map<" not in kind]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    wide = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(wide, [*keys, "_salt"], how).drop("_salt")


def one_row(df: DataFrame, **aggregates) -> Column:  # noqa: ANN003
    """All aggregates of a table as one struct from a scalar subquery, to be used beside its rows."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("_one")).scalar()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
