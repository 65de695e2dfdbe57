"""Chapter timelines: offsets, as-of lookup, re-ranking, the gate before a chapter is put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(timeline: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Add offset_ms: the sum of the durations before a segment in its chapter."""
    before = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return timeline.withColumn("offset_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).cast("long"))


def as_of(probes: DataFrame, timeline: DataFrame, key: str = "chapter_id") -> DataFrame:
    """(probe columns, position): the last segment of the chapter that starts at or before `ms`; the later of equals.

    Probes and segments are put on one line, sorted once and carried forward, so a long chapter costs a sort, not a product.
    """
    marks = timeline.where(F.col("offset_ms").isNotNull()).select(key, F.col("offset_ms").alias("ms"), F.lit(0).alias("kind"), F.col("position").alias("at"), *[F.lit(None).cast(t).alias(f"_{n}") for n, t in probes.dtypes])
    asked = probes.select(key, "ms", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("at"), *[F.col(n).alias(f"_{n}") for n in probes.columns])
    line = Window.partitionBy(key).orderBy("ms", "kind", "at").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("position", F.last("at", ignorenulls=True).over(line)).where("kind = 1")
    return found.select(*[F.col(f"_{n}").alias(n) for n in probes.columns], "position")


def totals(timeline: DataFrame, key: str = "chapter_id") -> DataFrame:
    return timeline.groupBy(key).agg(F.sum("duration_ms").cast("long").alias("total_ms"), F.count("*").alias("segments"))


def changed_priorities(queue: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """(by, chapter_id, priority) of the rows whose priority must change so that order becomes n, n - 1, .. 1."""
    w = Window.partitionBy(by)
    wanted = (F.count("*").over(w) - F.row_number().over(w.orderBy(*order)) + 1).cast("int")
    return queue.withColumn("wanted", wanted).where("wanted <> priority").select(by, "chapter_id", F.col("wanted").alias("priority"))


def ready_chapters(segments: DataFrame, takes: DataFrame) -> DataFrame:
    """(chapter_id, ready): whether every segment has a selected take with audio."""
    chosen = takes.where(F.col("is_selected") & F.col("audio_path").isNotNull()).select("segment_id", F.lit(True).alias("has")).distinct()
    return segments.join(chosen, "segment_id", "left").groupBy("chapter_id").agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("ready"))


def moved_priorities(queue: DataFrame, moves: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The same after moves (by, chapter_id, to): one row of each list taken out and put in at place `to`, counted from 1."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    placed = queue.withColumn("_at", place).join(moves.select(by, F.col("chapter_id").alias("_moved"), "to"), by)
    own = placed.where(F.col("chapter_id") == F.col("_moved")).select(by, F.col("_at").alias("_from"))
    going = F.col("chapter_id") == F.col("_moved")
    # Half a place after the target when it moves down, half a place before it when it moves up.
    key = F.when(going, F.col("to") + F.when(F.col("to") > F.col("_from"), 0.5).otherwise(-0.5)).otherwise(F.col("_at").cast("double"))
    return changed_priorities(placed.join(own, by).withColumn("_key", F.when(going & (F.col("to") == F.col("_from")), F.col("_at")).otherwise(key)), by, [F.asc("_key")])
