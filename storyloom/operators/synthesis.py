"""From scripts to audio: chunk merging, cast persistence, voices and takes, all as snapshot functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import labels
from storyloom.operators.cast import NARRATOR
from storyloom.operators.segment import merge_casts
from storyloom.sources.providers import Provider, analyse

# What each language profile is called by speech services.
LOCALES = {"en": "en-US", "fr": "fr-FR"}
LANGUAGE_NAMES = {"en": "English", "fr": "French"}


def renumber(script: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Positions 1, 2, .. of a chapter over its chunks in order; only narrow rows need to be sorted together."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("chunk", "position"))
    return script.withColumn("position", place).drop("chunk")


def new_cast(sighted: DataFrame, existing: DataFrame, key: str = "book_id") -> DataFrame:
    """The names that a book's cast does not have yet, each as first seen by (chunk, ord); an existing character keeps its traits."""
    fresh = sighted.where(F.col("name").isNotNull()).join(existing.select(key, "name"), [key, "name"], "left_anti")
    return merge_casts(fresh, key)


def with_character_ids(script: DataFrame, cast: DataFrame, key: str = "book_id") -> DataFrame:
    """The script with character_id by (book, name); null where no one is named or the name is not cast."""
    named = cast.select(key, F.col("name").alias("character_name"), "character_id")
    return script.join(named, [key, "character_name"], "left")


def locale_of(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LOCALES.items() for x in pair])[X.language_profile(language)]


def language_name(language: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])[X.language_profile(language)]


def physical_voices(lines: DataFrame, mapping: DataFrame, default_locale: str) -> DataFrame:
    """lines with `physical`, the service's own voice: mapping has (locale, voice_id, physical); an unknown locale is read as the
    default one, and a voice that the mapping lacks gives an `error` instead of a voice."""
    known = F.broadcast(mapping.select("locale").distinct().withColumn("known", F.lit(True)))  # a few locales
    placed = lines.join(known, "locale", "left").withColumn("locale", F.when(F.col("known"), F.col("locale")).otherwise(default_locale)).drop("known")
    found = placed.join(F.broadcast(mapping.select("locale", "voice_id", "physical")), ["locale", "voice_id"], "left")
    return found.withColumn("error", F.when(F.col("physical").isNull(), F.concat(F.lit("unknown voice "), F.col("voice_id"))))


def synthesis_order(transcript: DataFrame, voices: DataFrame, key: str = "chapter_id") -> DataFrame:
    """transcript (with voice_id) with reference_path and turn: voices without a reference first, then cloned ones, each by position.

    A model that clones is loaded once a chapter; the audio is put back in reading order afterwards.
    """
    paths = voices.select("voice_id", F.col("reference_audio_path").alias("reference_path"))
    joined = transcript.join(paths, "voice_id", "left")
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.col("reference_path").isNotNull(), "position"))
    return joined.withColumn("turn", turn)


def used_voices(characters: DataFrame) -> DataFrame:
    """(book_id, voices): the voices of a book's cast and the narrator."""
    return characters.groupBy("book_id").agg(F.array_sort(F.array_union(F.collect_set("voice_id"), F.array(F.lit(NARRATOR)))).alias("voices"))


#: Heads the list of a book's cast in a prompt.
MERGE_QUESTION = "Which of these names belong to one and the same person? One name a row, then what is known of it."


def merge_prompts(characters: DataFrame) -> DataFrame:
    """(book_id, prompt): a question and a row for each character, its name and what is told of it between bars; books with one
    character ask nothing."""
    line = F.concat_ws(" | ", "name", *[F.nullif(c, F.lit("")) for c in ("gender", "age_category", "description")])
    lines = characters.select("book_id", F.struct("character_id", line.alias("line")).alias("s")).groupBy("book_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    told = lines.where(F.size("all") > 1)
    return told.select("book_id", F.concat(F.lit(MERGE_QUESTION + "\n"), F.array_join(F.transform("all", lambda s: s["line"]), "\n")).alias("prompt"))


def suggested_merges(characters: DataFrame, provider: Provider) -> DataFrame:
    """(book_id, ord, survivor_name, merged_name, reason) that a model suggests; it is asked once for each book of two characters or
    more, and what it says of unknown names, or of a name and itself, is skipped."""
    return labels.merges(analyse(merge_prompts(characters), provider, "book_id"), characters)


def new_takes(asked: DataFrame, segments: DataFrame, characters: DataFrame) -> DataFrame:
    """(segment_id, voice_id, emotion, is_selected): a take for each request (segment_id, voice_id, emotion); without a voice it
    gets its character's one, whatever the segment's type, else the narrator."""
    cast = characters.select("character_id", F.col("voice_id").alias("own"))
    joined = asked.join(segments.select("segment_id", "character_id"), "segment_id").join(cast, "character_id", "left")
    return joined.select("segment_id", F.coalesce("voice_id", "own", F.lit(NARRATOR)).alias("voice_id"), "emotion", F.lit(False).alias("is_selected"))


def regenerated_takes(takes: DataFrame, made: DataFrame) -> DataFrame:
    """(segment_id, voice_id, is_selected): segments that were read anew have one selected take, in the voice that read them."""
    kept = takes.join(made.select("segment_id"), "segment_id", "left_anti").select("segment_id", "voice_id", "is_selected")
    return kept.unionByName(made.select("segment_id", "voice_id", F.lit(True).alias("is_selected")))
