"""Arriving chapters and books as streams. The unit of resumption is a chapter, or a book file, and not a batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyloom.operators.segment import segments
from storyloom.sources import epub

SCHEMA = "chapter_id long, language string, raw_text string"
DONE = "chapter_id long, batch long"


def chapter_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def segment_stream(chapters: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the segments of arriving chapters; a batch that is repeated after a failure replaces its own output.

    After its segments, a batch logs its chapters in `_done`, a hidden folder of out; current_segments() goes by it. So a batch
    that ends half-way shows nothing, and a chapter that comes again replaces its own segments and no others'.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        segments(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        done = batch.select("chapter_id").distinct().withColumn("batch", F.lit(epoch).cast("long"))
        done.write.mode("overwrite").parquet(f"{out}/_done/{epoch}")

    return chapters.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _read(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    try:
        return spark.read.options(**options).schema(schema).parquet(path)
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def done_chapters(spark: SparkSession, out: str) -> DataFrame:
    """(chapter_id, batch): the last batch that finished each chapter, also where it has no segment."""
    return _read(spark, f"{out}/_done", DONE, recursiveFileLookup="true").groupBy("chapter_id").agg(F.max("batch").alias("batch"))


def current_segments(spark: SparkSession, out: str) -> DataFrame:
    """The segments of the last finished batch of each chapter."""
    rows = _read(spark, out, "chapter_id long, position int, index int, text string, segment_type string, batch long")
    return rows.join(done_chapters(spark, out), ["chapter_id", "batch"], "left_semi").drop("batch")


def left_to_segment(chapters: DataFrame, spark: SparkSession, out: str) -> DataFrame:
    """The chapters that no batch has finished."""
    return chapters.join(done_chapters(spark, out), "chapter_id", "left_anti")


def book_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a landing folder as they arrive; the stream's log knows those that it has seen."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(folder)


def landing_stream(files: DataFrame, out: str, checkpoint: str, max_bytes: int = epub.MAX_BYTES) -> StreamingQuery:
    """Parse each book that arrives, once: rows of the EPUB scan, in a folder for each batch, which a repeated batch replaces."""

    def write(batch: DataFrame, epoch: int) -> None:
        epub.parsed(batch, max_bytes).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
