"""Helpers that the operators of this subpackage share: staged tables, distributed numbering, range buckets."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: For each thread, the folders that are removed when its innermost scratch() block ends.
_LOCAL = threading.local()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where both are one process (tests) may the session name none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="spark-staged-")
    return _OWN_DIRS[app]


def _blocks() -> list[list[str]]:
    return _LOCAL.__dict__.setdefault("blocks", [])


def new_path(spark: SparkSession, label: str, outlive: bool = False) -> str:
    """A folder of its own; outlive leaves it to the scratch() block around the innermost one, if any."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    blocks = _blocks()
    if len(blocks) > outlive:
        blocks[-2 if outlive else -1].append(path)
    return path


def stage(df: DataFrame, label: str, outlive: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label, outlive)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged inside when the block ends, but for what outlives it; nothing else staged there may be read later."""
    _blocks().append([])
    try:
        yield
    finally:
        for path in _blocks().pop():
            remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(key: str | Column) -> Column:
    """crc32 of the key as text, modulo 4; the remainder 2 is the held-out fold."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 4


def held_out(key: str | Column) -> Column:
    return F.coalesce(crc_fold(key) == 2, F.lit(False))


def running_offsets(counts: DataFrame, key: str, n: str, out: str) -> DataFrame:
    """Exclusive running sum of n by key. counts has one row for each partition or group number, never one for each row."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long").alias(out))


def global_positions(df: DataFrame, keys: list[str | Column], label: str, pos: str = "_pos") -> DataFrame:
    """Number all rows gaplessly from 0 in the order of keys, without a window over them.

    The rows are range-partitioned and sorted once and written with their place inside their partition; one offset for
    each partition makes that place global. The written table fixes the ranges, so the count and the numbering agree.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    placed = stage(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", 33).alias("_part")
    offsets = running_offsets(placed.groupBy(part).agg(F.count("*").alias("_n")), "_part", "_n", "_offset")
    at = F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(pos, at).drop("_part", "_mid", "_offset")


def range_bounds(df: DataFrame, key: str, parts: int) -> list[float]:
    """At most parts - 1 ascending cut points of a numeric key, from a sketch of the key column alone."""
    if parts < 2:
        return []
    got = df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], max(1e-4, 1 / (8 * parts)))
    return sorted(set(got))


def range_bucket(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """Number of the range that the key lies in; null keys come first."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    inf = float("inf")
    keyed = df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(-inf)))
    cut = Bucketizer(splits=[-inf, *bounds, inf], inputCol="_key", outputCol="_cut")
    return cut.transform(keyed).withColumn(out, F.col("_cut").cast("int")).drop("_key", "_cut")


def give_back() -> None:
    """Return what the process has freed to the system: a worker lives on after its task, beside the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a worker makes of one stays small."""
    give_back()  # what the worker's last task has left
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()
