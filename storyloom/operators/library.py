"""Reads of the library: queue, transcript, cast counts, facets, sorted lists, resume sets, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators.cast import NARRATOR

LIVE = ("PENDING", "PROCESSING", "GENERATING")


def queue_view(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters being generated, and queued pending ones, with their book's title; rank by generating, priority, book, place."""
    member = (F.col("status") == "GENERATING") | ((F.col("status") == "PENDING") & F.col("queued"))
    joined = chapters.where(member).join(books.select("book_id", "title"), "book_id")
    return joined.select("chapter_id", "book_id", "title", "status", "priority", "position", (F.col("status") == "GENERATING").alias("generating"))


def queue_order() -> list[Column]:
    return [F.desc("generating"), F.desc("priority"), F.asc("book_id"), F.asc("position")]


def next_chapter(chapters: DataFrame) -> DataFrame:
    """The queued pending chapter that the pump takes next; ties between books go to the smaller book."""
    return chapters.where((F.col("status") == "PENDING") & F.col("queued")).orderBy(F.desc("priority"), "position", "book_id").limit(1)


def transcript(segments: DataFrame, characters: DataFrame) -> DataFrame:
    """Segments with speaker and voice: narration, unknown speakers and uncast characters are read by the narrator."""
    cast = characters.select("character_id", F.col("name").alias("character_name"), "voice_id")
    spoken = (F.col("segment_type") == "DIALOGUE") & F.col("character_id").isNotNull()
    voice = F.when(spoken, F.coalesce("voice_id", F.lit(NARRATOR))).otherwise(NARRATOR)
    return segments.join(cast, "character_id", "left").select("segment_id", "chapter_id", "position", "segment_type", "character_name", voice.alias("voice_id"))


def cast_counts(characters: DataFrame, segments: DataFrame) -> DataFrame:
    """Characters with the number of their segments, zero included."""
    counts = segments.where(F.col("character_id").isNotNull()).groupBy("character_id").agg(F.count("*").alias("n"))
    return characters.join(counts, "character_id", "left").select("book_id", "character_id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("line_count"))


def filter_library(books: DataFrame, status: str | None = None, provider: str | None = None, genre: str | None = None, author: str | None = None, language: str | None = None, search: str | None = None) -> DataFrame:
    """Facets that are given all hold; provider `default` means none is set; search looks into title and author."""
    out = books
    for column, value in (("status", status), ("genre", genre), ("author", author), ("language", language)):
        if value:
            out = out.where(F.col(column) == value)
    if provider:
        out = out.where(F.col("tts_provider").isNull() if provider == "default" else F.col("tts_provider") == provider)
    if search and search.strip():
        needle = search.strip().lower()
        out = out.where(F.lower("title").contains(needle) | F.lower(F.coalesce("author", F.lit(""))).contains(needle))
    return out


def library_order(mode: str) -> list[Column]:
    """Sort keys of the five list orders; books without a date of publication come last in both directions."""
    orders = {
        "recent": [F.desc("created_at")],
        "title": [F.asc(F.lower("title"))],
        "author": [F.asc(F.lower(F.coalesce("author", F.lit(""))))],
        "published_desc": [F.desc_nulls_last("published_at")],
        "published_asc": [F.asc_nulls_last("published_at")],
    }
    return [*orders[mode], F.asc("book_id")]


def facets(books: DataFrame) -> DataFrame:
    """(facet, value): distinct values without blanks."""
    kinds = F.explode(F.create_map(*[x for c in ("genre", "author", "language") for x in (F.lit(c), F.col(c))])).alias("facet", "value")
    return books.select(kinds).where(F.coalesce(X.strip(F.col("value")), F.lit("")) != "").distinct()


def unanalysed(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Chapters without any segment: what a resumed analysis still has to do, and what blocks generation."""
    return chapters.join(segments.select("chapter_id"), "chapter_id", "left_anti")


def missing_positions(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, missing): ascending places of the chapters without segments."""
    return unanalysed(chapters, segments).groupBy("book_id").agg(F.array_sort(F.collect_list("position")).alias("missing"))


def progress(chapters: DataFrame) -> DataFrame:
    """(book_id, chapters, done, progress): generation runs from 60 to 90 percent."""
    counted = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.count_if(F.col("status") == "DONE").alias("done"))
    return counted.withColumn("progress", F.round(60 + F.col("done") / F.col("chapters") * 30, 6))


def playable(chapters: DataFrame) -> DataFrame:
    """Done chapters with the neighbours that a player can go to."""
    w = Window.partitionBy("book_id").orderBy("position")
    done = chapters.where(F.col("status") == "DONE")
    return done.select("book_id", "chapter_id", "position", F.lag("chapter_id").over(w).alias("previous_id"), F.lead("chapter_id").over(w).alias("next_id"))


def voice_hues(voices: DataFrame) -> DataFrame:
    """(voice_id, hue): golden-angle steps by rank of the id; voices are a small dimension."""
    rank = F.row_number().over(Window.orderBy("voice_id")) - 1
    return voices.select("voice_id", F.round(F.pmod(rank * F.lit(137.508), F.lit(360.0)), 3).alias("hue"))


def assignable_voices(voices: DataFrame) -> DataFrame:
    """Voices that a character may get: the catalogue without the narrator, and clones."""
    return voices.where(((F.col("kind") == "CATALOGUE") & (F.col("voice_id") != NARRATOR)) | (F.col("kind") == "CLONED")).select("voice_id").distinct()


def speech_stats(segments: DataFrame) -> DataFrame:
    """(book_id, dialogue, attributed, mean, least, most): attribution over chapters."""
    by_chapter = segments.groupBy("book_id", "chapter_id").agg(F.count_if(F.col("segment_type") == "DIALOGUE").alias("d"), F.count_if((F.col("segment_type") == "DIALOGUE") & F.col("character_id").isNotNull()).alias("a"))
    return by_chapter.groupBy("book_id").agg(F.sum("d").alias("dialogue"), F.sum("a").alias("attributed"), F.round(F.avg("d"), 6).alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"))


def filter_voices(voices: DataFrame, favourites: bool = False, gender: str | None = None, kind: str | None = None, locale: str | None = None, sample: bool | None = None, search: str | None = None) -> DataFrame:
    """Conditions that are given all hold; sample tells whether there must be one."""
    out = voices.where("is_favorite") if favourites else voices
    for column, value in (("gender", gender), ("kind", kind), ("locale", locale), ("has_sample", sample)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return search_names(out, search)


def search_names(rows: DataFrame, search: str | None) -> DataFrame:
    needle = (search or "").strip().lower()
    return rows.where(F.lower("name").contains(needle)) if needle else rows


def offered_voices(voices: DataFrame, provider: str) -> DataFrame:
    """Voices offered for a character: all but the narrator, and clones only where the provider clones."""
    return voices.where((F.col("voice_id") != NARRATOR) & ((F.col("kind") == "CATALOGUE") | F.lit(provider == "qwen")))


def cast_order(counts: DataFrame) -> DataFrame:
    """counts with `bucket` (main, or silent without a line) and place: in a book by lines, the most first, then by name."""
    bucket = F.when(F.col("line_count") > 0, "main").otherwise("silent")
    place = F.row_number().over(Window.partitionBy("book_id", "bucket").orderBy(F.desc("line_count"), "name", "character_id"))
    return counts.withColumn("bucket", bucket).withColumn("place", place)


def ranked_queue(queue: DataFrame) -> DataFrame:
    """The queue view with its rank in a book's part of it."""
    return queue.withColumn("place", F.row_number().over(Window.partitionBy("generating", "priority", "book_id").orderBy("position", "chapter_id")))


def analysis_progress(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(book_id, progress): analysis runs from 10 to 60 percent, by chapters that have segments."""
    done = segments.select("chapter_id").distinct().withColumn("_done", F.lit(1))
    counted = chapters.join(done, "chapter_id", "left").groupBy("book_id").agg(F.count("*").alias("n"), F.count("_done").alias("k"))
    return counted.select("book_id", F.round(10 + F.col("k") / F.col("n") * 50, 6).alias("progress"))


def left_to_generate(chapters: DataFrame) -> DataFrame:
    """What a resumed generation still has to do."""
    return chapters.where(F.col("status") != "DONE")
