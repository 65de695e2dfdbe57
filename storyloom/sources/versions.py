"""Tables whose files have been written under several schema versions, read as one.

Every version adds columns and takes none away. Its files lie in a folder `v=<n>`; files outside of such a folder stem from
before versions were told and count as the baseline, version 0. A row is completed by the version of its file: a column that
the version did not have yet gets its default, while a null in a column that it had stays null. Folders are partitions, so the
version comes from the path and neither the driver nor a task looks into files for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Added:
    version: int
    column: str
    kind: str
    default: object = None


#: What each version has added to the library's tables.
ADDED = {
    "book": (Added(1, "failed_stage", "string"),),
    "chapter": (Added(2, "priority", "int", 0), Added(2, "cancel_requested", "boolean", False), Added(3, "queued_at", "timestamp_ntz")),
}


def latest(added: tuple[Added, ...]) -> int:
    return max((a.version for a in added), default=0)


def write_version(table: DataFrame, path: str, version: int | None = None) -> None:
    """Append rows as files of a version; None writes them as they were before versions were told."""
    table.write.mode("append").parquet(path if version is None else f"{path}/v={version}")


def read_versions(spark: SparkSession, path: str, baseline: str, added: tuple[Added, ...]) -> DataFrame:
    """All rows under path with the columns of the latest version. baseline: the columns of version 0. A later version than the
    latest known one is an error, as its columns would be lost."""
    known = [*(c.strip() for c in baseline.split(",")), *(f"{a.column} {a.kind}" for a in added), "v int"]
    folders = [f"{path}/v={n}" for n in range(latest(added) + 1)]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    unknown = sorted(n for n in there if n.startswith("v=") and f"{path}/{n}" not in folders)
    if unknown:
        raise ValueError(f"written by a later version: {', '.join(unknown)}")
    names = [k.split()[0] for k in known if k != "v int"]
    parts = []
    for n in range(latest(added) + 1):
        if f"v={n}" in there:
            parts.append(spark.read.schema(", ".join(known[:-1])).parquet(f"{path}/v={n}").withColumn("v", F.lit(n)))
    if any(n.endswith(".parquet") for n in there):
        parts.append(spark.read.schema(", ".join(known[:-1])).option("pathGlobFilter", "*.parquet").parquet(f"{path}/*.parquet").withColumn("v", F.lit(0)))
    if not parts:
        return spark.createDataFrame([], ", ".join(known[:-1]))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    since = {a.column: a for a in added}
    filled = [F.when(F.col("v") < since[n].version, F.lit(since[n].default).cast(since[n].kind)).otherwise(F.col(n)).alias(n) if n in since else F.col(n) for n in names]
    return every.select(*filled)


def schema_state(columns: list[str], baseline: str, added: tuple[Added, ...]) -> tuple[int | None, list[str]]:
    """(version, missing): the latest version that all of its columns are there for, None without the baseline's; and what the latest lacks."""
    have, base = set(columns), {c.split()[0] for c in baseline.split(",")}
    missing = sorted(({a.column for a in added} | base) - have)
    if base - have:
        return None, missing
    version = 0
    while version < latest(added) and all(a.column in have for a in added if a.version <= version + 1):
        version += 1
    return version, missing
