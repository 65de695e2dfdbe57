"""A sink for binary files with a commit: a file is visible to readers once the write that made it has ended, and only then.

Tasks write files of their own under `data/<job>/<task>`, piece by piece, so that a file never has to fit in memory, and beside
them a list of these, `data/<job>/<task>.json`. The driver's commit adds one line for each task to the log; readers take the
lists of logged tasks alone, so no folder of files is ever listed, and open files in tasks. A write that fails is removed and
leaves no line; what a lost driver leaves behind has no line either. A later write of a name replaces the earlier.

A name is letters, digits, `_` and `-` in folders, and an extension; the first piece of a file is not empty. Anything else
fails the write. Files go to any file system that Arrow reaches by URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "audio_files"
LOG = "job string, committed long, folder string, files long, bytes long"
LIST = "folder string, name string, length long"
#: Bytes of contents that a batch of read files has, unless it is one file.
BATCH = 16 << 20
_NAME = re.compile(r"[A-Za-z0-9_\-]+(/[A-Za-z0-9_\-]+)*(\.[A-Za-z0-9]+)?")


def _opened(root: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(root if ":" in root.split("/")[0] else f"file://{root}")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


class AudioFiles(DataSource):
    """df.write.format("audio_files").mode("append").save(root) of (name, at, content): pieces of files, in order within a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, at long, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return AudioWriter(self.options["path"], schema.fieldNames())


class AudioWriter(DataSourceArrowWriter):
    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns, self.job = root, columns, uuid.uuid4().hex

    def _opened(self) -> tuple[FileSystem, str]:
        return _opened(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = self._opened()
        task = TaskContext.get()
        folder = f"{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        done: dict[str, int] = {}
        made: set[str] = set()
        now, out, written = "", None, 0
        try:
            for batch in iterator:
                for name, at, content in zip(*(batch.column(self.columns.index(c)) for c in ("name", "at", "content")), strict=True):
                    name, at = name.as_py(), at.as_py()
                    if name != now:
                        if out is not None:
                            out.close()
                        if name is None or not _NAME.fullmatch(name) or name in done:
                            raise ValueError(f"not a file name, or its pieces are apart: {name}")
                        path = f"{base}/data/{folder}/{name}"
                        above = path.rsplit("/", 1)[0]
                        if above not in made:
                            fs.create_dir(above, recursive=True)
                            made.add(above)
                        now, out, written = name, fs.open_output_stream(path), 0
                    if at != written:
                        raise ValueError(f"{name}: piece at {at} after {written} bytes")
                    body = content.as_buffer()
                    if not at and not (body and body.size):
                        raise ValueError(f"{name}: an empty file would not be read back")
                    out.write(body)
                    written += body.size
                    done[name] = written
        finally:
            if out is not None:
                out.close()
        if done:
            with fs.open_output_stream(f"{base}/data/{folder}.json") as told:
                told.write("".join(json.dumps({"folder": folder, "name": n, "length": size}) + "\n" for n, size in done.items()).encode())
        return Written(folder, len(done), sum(done.values()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = self._opened()
        told = [m for m in messages if m is not None and m.files]
        kept = {m.folder.split("/")[1] for m in told}
        for found in fs.get_file_info(FileSelector(f"{base}/data/{self.job}", allow_not_found=True)):
            if found.base_name.removesuffix(".json") not in kept:  # of an attempt that did not count
                (fs.delete_dir if found.type == FileType.Directory else fs.delete_file)(found.path)
        lines = "".join(json.dumps({"job": self.job, "committed": time.time_ns() // 1000, "folder": m.folder, "files": m.files, "bytes": m.bytes}) + "\n" for m in told)
        fs.create_dir(f"{base}/log", recursive=True)
        aside = f"{base}/log/_{self.job}"  # readers leave out what starts so
        with fs.open_output_stream(aside) as out:
            out.write(lines.encode())
        fs.move(aside, f"{base}/log/{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = self._opened()
        if fs.get_file_info(f"{base}/data/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{base}/data/{self.job}")


def write_files(files: DataFrame, root: str) -> None:
    """Write (name, content), or pieces (name, at, content) of larger files; each name's pieces are brought together and in order."""
    spark = files.sparkSession
    spark.dataSource.register(AudioFiles)
    whole = "at" not in files.columns
    pieces = files.select("name", F.lit(0).cast("long").alias("at") if whole else F.col("at").cast("long"), "content")
    ordered = pieces if whole else pieces.repartition("name").sortWithinPartitions("name", "at")
    ordered.write.format(FORMAT).mode("append").save(root)


def listed_files(spark: SparkSession, root: str, within: str = "") -> DataFrame:
    """(name, path, length) of the files of committed writes, the latest of each name; within: how the names begin."""
    try:
        log = spark.read.schema(LOG).json(f"{root}/log")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, path string, length long")
    try:
        lists = spark.read.schema(LIST).json(f"{root}/data/*/*.json")
    except AnalysisException as why:  # only empty writes
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "name string, path string, length long")
    known = lists.where(F.col("name").startswith(within)).join(log.select("folder", "committed", "job"), "folder")
    latest = known.groupBy("name").agg(F.max(F.struct("committed", "job", "folder", "length")).alias("last"))
    return latest.select("name", F.concat(F.lit(f"{root.rstrip('/')}/data/"), "last.folder", F.lit("/"), "name").alias("path"), F.col("last.length").alias("length"))


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Add content to rows that have the path and the length of a file under root; each is opened by the task that has its row."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(root)
        cut = len(root.rstrip("/")) - len(base.rstrip("/"))
        for batch in batches:
            paths, sizes = batch.column("path").to_pylist(), batch.column("length").to_pylist()
            at = 0
            while at < len(paths):
                end, size = at + 1, sizes[at]
                while end < len(paths) and size + sizes[end] <= BATCH:
                    size += sizes[end]
                    end += 1
                found = []
                for path, length in zip(paths[at:end], sizes[at:end], strict=True):
                    with fs.open_input_stream(path[cut:]) as file:
                        found.append(file.read())
                    if len(found[-1]) != length:
                        raise ValueError(f"{path}: {len(found[-1])} bytes where {length} were written")
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "content"])
                at = end

    # Adaptive execution would bring so short rows into few tasks, whatever the files hold.
    spread = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(opened, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def read_files(spark: SparkSession, root: str, within: str = "") -> DataFrame:
    """(name, path, length, content) of the files of committed writes, the latest of each name; within: how the names begin."""
    return with_content(listed_files(spark, root, within), root)
