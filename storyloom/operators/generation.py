"""Chapter audio as files: assembled chapters, their takes, and the ledger of finished chapters that readers go by."""

from __future__ import annotations

import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.sources import audio_files, wav

LEDGER = "chapter_id long, run string, frames long, finished long"


def outcomes(segments: DataFrame, audio: DataFrame, stops: DataFrame) -> DataFrame:
    """(chapter_id, segments, voiced, status): DONE where every segment has audio and nobody asked to stop, else PENDING again.

    segments: chapter_id, segment_id; audio: segment_id, audio (null where synthesis gave up); stops: chapter_id.
    """
    voiced = segments.select("chapter_id", "segment_id").join(audio.where("audio is not null").select("segment_id", F.lit(1).alias("has")).distinct(), "segment_id", "left")
    counted = voiced.groupBy("chapter_id").agg(F.count("*").alias("segments"), F.count("has").alias("voiced"))
    asked = counted.join(stops.select("chapter_id", F.lit(True).alias("stop")).distinct(), "chapter_id", "left")
    done = (F.col("segments") == F.col("voiced")) & F.col("stop").isNull()
    return asked.select("chapter_id", "segments", "voiced", F.when(done, "DONE").otherwise("PENDING").alias("status"))


def take_rows(chapters: DataFrame, spans: DataFrame) -> DataFrame:
    """(segment_id, chapter_id, voice_id, is_selected, audio): a take for each segment, cut from its chapter's audio.

    chapters: chapter_id, audio; spans: chapter_id, segment_id, voice_id, first_frame, frames (milliseconds, rounded down for each
    segment, would drift away from the samples). A chapter's spans meet its audio in one row, so that it is moved and walked once.
    """
    kinds = dict(spans.dtypes)
    # Spans are short, so adaptive execution would bring all into few tasks, however much audio they cut.
    spread = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chapter_id")
    told = spread.groupBy("chapter_id").agg(F.collect_list(F.struct("segment_id", "voice_id", "first_frame", "frames")).alias("spans"))
    met = chapters.select("chapter_id", "audio").join(told, "chapter_id").select("chapter_id", "spans", "audio")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for chapter, spans_of, audio in zip(batch.column("chapter_id").to_pylist(), batch.column("spans").to_pylist(), batch.column("audio"), strict=True):
                with wave.open(pa.BufferReader(audio.as_buffer())) as src:
                    rate, width, channels, whole = src.getframerate(), src.getsampwidth(), src.getnchannels(), src.getnframes()
                    for span in spans_of:
                        if not 0 <= span["first_frame"] <= whole:
                            taken = None  # begins beyond the samples
                        else:
                            src.setpos(span["first_frame"])
                            taken = wav.wrap_pcm(src.readframes(max(span["frames"], 0)), rate, channels, width)
                        rows.append((span["segment_id"], chapter, span["voice_id"], taken))
                        size += len(taken or b"")
                        if size >= audio_files.BATCH:
                            yield packed(batch, rows)
                            rows, size = [], 0
            if rows:
                yield packed(batch, rows)

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        inner, names = batch.schema.field("spans").type.value_type, ["segment_id", "chapter_id", "voice_id", "audio"]
        types = [inner.field("segment_id").type, batch.schema.field("chapter_id").type, inner.field("voice_id").type, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    made = met.mapInArrow(cut, f"segment_id {kinds['segment_id']}, chapter_id {kinds['chapter_id']}, voice_id {kinds['voice_id']}, audio binary")
    return made.select("segment_id", "chapter_id", "voice_id", F.lit(True).alias("is_selected"), "audio")


def write_chapters(spark: SparkSession, root: str, run: str, segments: DataFrame, audio: DataFrame, stops: DataFrame) -> DataFrame:
    """Assemble and write what a run synthesised: chapters/<id>.wav and takes/<segment_id>.wav; returns outcomes().

    segments: chapter_id, segment_id, position, voice_id. Files are written first, for chapters whose segments all have audio;
    stops are read afterwards, so that a wish to stop that comes during the write still counts. Only then are the finished
    chapters added to the ledger, in one append, which makes them visible: what an abandoned chapter has written is not.
    """
    full = outcomes(segments, audio, stops.where(F.lit(False))).where("status = 'DONE'").select("chapter_id")
    voiced = segments.join(full, "chapter_id", "left_semi").join(audio, "segment_id")
    made = wav.assemble(voiced.select("segment_id", "chapter_id", "position", "audio")).where("error is null")
    audio_files.write_files(made.select(F.format_string("chapters/%d.wav", "chapter_id").alias("name"), F.col("audio").alias("content")), f"{root}/{run}")
    back = chapter_files(spark, root, run)
    sized = voiced.select("segment_id", "chapter_id", "position", "voice_id", wav.header(F.col("audio"))["frames"].alias("frames"))
    sized = sized.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chapter_id")  # as take_rows() needs them
    before = Window.partitionBy("chapter_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    spans = sized.withColumn("first_frame", F.coalesce(F.sum("frames").over(before), F.lit(0)))
    takes = take_rows(back.select("chapter_id", F.col("content").alias("audio")), spans)
    audio_files.write_files(takes.select(F.format_string("takes/%d.wav", "segment_id").alias("name"), F.col("audio").alias("content")), f"{root}/{run}")
    result = outcomes(segments, audio, stops)
    # A chapter's frames are those of its lines, which its file has in order.
    frames = sized.groupBy("chapter_id").agg(F.sum("frames").alias("frames")).join(listed(spark, root, run, "chapters", "chapter_id").select("chapter_id"), "chapter_id", "left_semi")
    done = result.where("status = 'DONE'").join(frames, "chapter_id")
    rows = done.select("chapter_id", F.lit(run).alias("run"), "frames", F.unix_micros(F.current_timestamp()).alias("finished"))
    rows.write.mode("append").parquet(f"{root}/ledger")
    return result


def listed(spark: SparkSession, root: str, run: str, kind: str, key: str) -> DataFrame:
    """(key, path, length) of all files of a kind that a run has written."""
    files = audio_files.listed_files(spark, f"{root}/{run}", f"{kind}/")
    return files.select(F.regexp_extract("name", r"/(-?[0-9]+)\.wav$", 1).cast("long").alias(key), "path", "length")


def _opened(files: DataFrame, key: str, root: str, run: str) -> DataFrame:
    return audio_files.with_content(files, f"{root}/{run}").select(key, "path", "content")


def chapter_files(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(chapter_id, path, content) of all chapters that a run has written, finished or not."""
    return _opened(listed(spark, root, run, "chapters", "chapter_id"), "chapter_id", root, run)


def take_files(spark: SparkSession, root: str, run: str) -> DataFrame:
    return _opened(listed(spark, root, run, "takes", "segment_id"), "segment_id", root, run)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The last run that finished each chapter."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], LEDGER)
    last = rows.groupBy("chapter_id").agg(F.max_by(F.struct("run", "frames"), F.struct("finished", "run")).alias("last"))
    return last.select("chapter_id", "last.run", "last.frames")


def finished_chapters(spark: SparkSession, root: str, run: str) -> DataFrame:
    """(chapter_id, path, content) that the ledger gives to this run: a later run of a chapter replaces it, an abandoned one is unseen."""
    mine = ledger(spark, root).where(F.col("run") == run).select("chapter_id")
    return _opened(listed(spark, root, run, "chapters", "chapter_id").join(mine, "chapter_id", "left_semi"), "chapter_id", root, run)


def finished_takes(spark: SparkSession, root: str, run: str, segments: DataFrame) -> DataFrame:
    mine = segments.join(ledger(spark, root).where(F.col("run") == run).select("chapter_id"), "chapter_id", "left_semi").select("segment_id")
    return _opened(listed(spark, root, run, "takes", "segment_id").join(mine, "segment_id", "left_semi"), "segment_id", root, run)


def remaining(segments: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """The segments of chapters that no run has finished: what a resumed run has to synthesise."""
    return segments.join(ledger(spark, root).select("chapter_id"), "chapter_id", "left_anti")
