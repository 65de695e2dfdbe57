"""Queries over audio that is written as files and read back, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import generation
from storyloom.plans.queries import query
from storyloom.plans.views import view
from storyloom.sources import audio_files, providers, wav
from storyloom.staging import new_path, stage

# Segments without audio and chapters with a wish to stop, as the statements below have them.
_SILENT, _STOPPED = "segment_id % 97 = 5", "chapter_id % 7 = 3"
_SAID = f""", said AS (
  SELECT segment_id, chapter_id, position, text || CASE WHEN octet_length(encode(text)) % 2 = 1 THEN ' ' ELSE '' END AS pcm, {_SILENT} AS silent FROM segment WHERE text IS NOT NULL
),
done AS (SELECT chapter_id FROM said GROUP BY chapter_id HAVING NOT bool_or(silent) AND NOT ({_STOPPED}))"""


def _run(spark: SparkSession, d: str) -> tuple[str, DataFrame, DataFrame]:
    """(root, segments, outcomes) of a run over all chapters."""
    rows = view(spark, d, "segment").where("text is not null")
    segments = rows.select("chapter_id", "segment_id", "position", F.lit("narrator").alias("voice_id"))
    lines = rows.select("segment_id", F.when(~F.expr(_SILENT), F.col("text")).alias("text"))
    audio = stage(providers.synthesise(lines, providers.echo), "speech")
    root = new_path(spark, "generated")
    stops = segments.where(_STOPPED).select("chapter_id").distinct()
    return root, segments, stage(generation.write_chapters(spark, root, "run", segments, audio, stops), "outcomes")


def _pcm() -> Column:
    return F.sha2(wav.samples(F.col("content")), 256).alias("pcm_sha256")


@query("chapter_files", "segment", _SAID + f""" SELECT chapter_id, count(*) AS segments, count(*) FILTER (NOT silent) AS voiced, CASE WHEN bool_or(silent) OR {_STOPPED} THEN 'PENDING' ELSE 'DONE' END AS status,
  CASE WHEN NOT bool_or(silent) AND NOT ({_STOPPED}) THEN CAST(sum(octet_length(encode(pcm)) // 2) AS BIGINT) END AS frames,
  CASE WHEN NOT bool_or(silent) AND NOT ({_STOPPED}) THEN sha256(string_agg(pcm, '' ORDER BY position)) END AS pcm_sha256 FROM said GROUP BY chapter_id""")
def chapter_files(spark, d):
    root, _, outcomes = _run(spark, d)
    seen = generation.finished_chapters(spark, root, "run").select("chapter_id", wav.header(F.col("content"))["frames"].alias("frames"), _pcm())
    return outcomes.join(seen, "chapter_id", "left").select("chapter_id", "segments", "voiced", "status", "frames", "pcm_sha256")


@query("take_files", "segment", _SAID + " SELECT segment_id, CAST(octet_length(encode(pcm)) // 2 AS BIGINT) AS frames, sha256(pcm) AS pcm_sha256 FROM said WHERE chapter_id IN (SELECT chapter_id FROM done)")
def take_files(spark, d):
    root, segments, _ = _run(spark, d)
    seen = generation.finished_takes(spark, root, "run", segments)
    return seen.select("segment_id", wav.header(F.col("content"))["frames"].alias("frames"), _pcm())


@query("generation_left", "segment", _SAID + " SELECT segment_id, chapter_id FROM said WHERE chapter_id NOT IN (SELECT chapter_id FROM done)")
def generation_left(spark, d):
    root, segments, _ = _run(spark, d)
    return generation.remaining(segments, spark, root).select("segment_id", "chapter_id")


@query("book_files", "segment", _SAID + """ SELECT chapter_id // 20 AS book_id, CAST(sum(octet_length(encode(pcm)) // 2) AS BIGINT) AS frames, CAST(sum(octet_length(encode(pcm))) + 44 AS BIGINT) AS bytes,
  sha256(string_agg(pcm, '' ORDER BY chapter_id, position)) AS pcm_sha256 FROM said WHERE chapter_id IN (SELECT chapter_id FROM done) GROUP BY 1""")
def book_files(spark, d):
    root, _, _ = _run(spark, d)
    chapters = generation.finished_chapters(spark, root, "run").withColumn("book_id", F.expr("chapter_id div 20"))
    pieces, _ = wav.joined(chapters, "book_id", "chapter_id")
    audio_files.write_files(pieces.select(F.format_string("%d.wav", "book_id").alias("name"), "at", "content"), f"{root}/books")
    books = audio_files.read_files(spark, f"{root}/books")
    return books.select(
        F.regexp_extract("name", r"^([0-9]+)\.wav$", 1).cast("long").alias("book_id"), wav.header(F.col("content"))["frames"].alias("frames"), F.col("length").alias("bytes"), _pcm()
    )


@query("audio_slices", "segment", """, said AS (SELECT segment_id, chapter_id, position, text || CASE WHEN octet_length(encode(text)) % 2 = 1 THEN ' ' ELSE '' END AS pcm FROM segment WHERE text IS NOT NULL),
whole AS (SELECT chapter_id, hex(encode(string_agg(pcm, '' ORDER BY position))) AS h FROM said GROUP BY chapter_id), cut AS (SELECT chapter_id, length(h) // 4 AS frames, h, least(100 + chapter_id % 50, length(h) // 4) AS a FROM whole)
SELECT chapter_id, CASE WHEN 100 + chapter_id % 50 <= frames THEN substr(h, 4 * a + 1, 4 * 250) END AS samples FROM cut""")
def audio_slices(spark, d):
    rows = view(spark, d, "segment").where("text is not null")
    speech = providers.synthesise(rows.select("segment_id", "text"), providers.echo)
    whole = wav.assemble(rows.select("segment_id", "chapter_id", "position").join(speech, "segment_id"))
    cut = whole.select("chapter_id", wav.slice_audio(F.col("audio"), 100 + F.col("chapter_id") % 50, F.lit(250)).alias("cut"))
    return cut.select("chapter_id", F.hex(wav.samples(F.col("cut"))).alias("samples"))
