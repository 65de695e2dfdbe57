"""Voices and casting: catalogue, scores, ranking, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X

# Voice, gender, age, tone tags, quality tags. The narrator is in no pool.
CATALOGUE = (
    ("narrator", None, "ADULT", ["neutral", "smooth"], ["smooth"]),
    ("male_0", "MALE", "ADULT", ["warm", "neutral"], ["deep"]),
    ("male_1", "MALE", "YOUNG_ADULT", ["gentle", "neutral"], ["smooth"]),
    ("male_2", "MALE", "ELDER", ["cold", "commanding"], ["deep", "raspy"]),
    ("female_0", "FEMALE", "ADULT", ["warm", "gentle"], ["smooth"]),
    ("female_1", "FEMALE", "YOUNG_ADULT", ["neutral"], ["bright"]),
    ("female_2", "FEMALE", "ELDER", ["gentle"], ["smooth"]),
    ("neutral_0", "NEUTRAL", "ADULT", ["warm", "neutral"], ["smooth"]),
    ("neutral_1", "NEUTRAL", "ADULT", ["neutral"], ["deep"]),
)
NARRATOR = "narrator"


def catalogue(spark: SparkSession) -> DataFrame:
    """(ord, voice_id, name, gender, age, tones, qualities): narrator first, then the pools."""
    rows = [(i, *voice) for i, voice in enumerate(CATALOGUE)]
    made = spark.createDataFrame(rows, "ord int, voice_id string, gender string, age string, tones array<string>, qualities array<string>")
    return made.select("ord", "voice_id", X.humanize(F.col("voice_id")).alias("name"), "gender", "age", "tones", "qualities")


def pool_gender(gender: Column) -> Column:
    return F.when(gender == "UNKNOWN", "NEUTRAL").otherwise(gender)


def voice_scores(characters: DataFrame) -> DataFrame:
    """Each character with each voice: 4 for the gender, 2 for the age, 1 for the tone, 1 for the quality; the narrator -10."""
    voices = F.broadcast(catalogue(characters.sparkSession).select("voice_id", F.col("gender").alias("voice_gender"), "age", "tones", "qualities"))
    has = lambda tags, trait: F.coalesce(F.array_contains(tags, F.lower(trait)), F.lit(False)).cast("int")
    score = (
        (F.col("voice_gender") == pool_gender(F.col("gender"))).cast("int") * 4
        + ((F.col("age_category") != "UNKNOWN") & (F.col("age") == F.col("age_category"))).cast("int") * 2
        + has(F.col("tones"), F.col("tone"))
        + has(F.col("qualities"), F.col("voice_quality"))
    )
    paired = characters.drop("voice_id").join(voices.withColumnRenamed("voice_id", "candidate"), F.lit(True))  # nine voices each
    return paired.select(*[c for c in characters.columns if c != "voice_id"], "candidate", "voice_gender", F.when(F.col("voice_gender").isNull(), -10).otherwise(score).alias("score"))


def ranked_voices(characters: DataFrame) -> DataFrame:
    """(character_id, candidates): the voices of a character's gender pool, best score first, then by id."""
    scored = voice_scores(characters).where(F.col("voice_gender") == pool_gender(F.col("gender")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "candidate")))
    return scored.groupBy("character_id").agg(F.transform(order, lambda x: x["candidate"]).alias("candidates"))


def assign_voices(characters: DataFrame, clones: DataFrame | None = None) -> DataFrame:
    """(book_id, character_id, name, voice_id) after casting each book in name order.

    A cast character keeps its voice. Others take the first free clone of their gender (where clones are given), then the best
    free voice of their pool, then the best one. All of a pool choose from the same voices, so as many of them as there are
    voices leave none free: only these first ones, a fixed few of each book and pool, are folded in order, inside an array. All
    later ones take their best voice without any of the others. Row numbers are cut off before the shuffle.
    """
    ranked = characters.join(ranked_voices(characters), "character_id", "left")
    pools = clones if clones is not None else characters.sparkSession.createDataFrame([], "voice_id string, gender string, ord long")
    mine = pools.where(F.col("gender").isNotNull()).groupBy(F.col("gender").alias("pool")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "voice_id"))), lambda x: x["voice_id"]).alias("clones"))
    none = F.array().cast("array<string>")
    ready = ranked.withColumn("pool", pool_gender(F.col("gender"))).join(mine, "pool", "left")
    ready = ready.select("book_id", "character_id", "name", "pool", "voice_id", F.coalesce("clones", none).alias("clones"), F.coalesce("candidates", none).alias("candidates"))
    voices = len(CATALOGUE) + (pools.count() if clones is not None else 0)
    turn = F.row_number().over(Window.partitionBy("book_id", "pool").orderBy(F.col("name").asc_nulls_last(), "character_id"))
    firsts = ready.where("voice_id is null").withColumn("turn", turn).where(F.col("turn") <= voices)
    used = ready.where(F.col("voice_id") != NARRATOR).groupBy("book_id").agg(F.collect_set("voice_id").alias("used"))
    row = F.struct("turn", "character_id", F.concat("clones", "candidates").alias("wanted"), "candidates")
    pooled = firsts.groupBy("book_id", "pool").agg(F.array_sort(F.collect_list(row)).alias("cast")).join(used, "book_id", "left")
    start = F.struct(F.coalesce("used", none).alias("used"), F.array().cast(f"array<struct<character_id:{dict(characters.dtypes)['character_id']},chosen:string>>").alias("out"))

    def choose(seen: Column, x: Column) -> Column:
        free = F.get(F.filter(x["wanted"], lambda v: ~F.array_contains(seen["used"], v)), F.lit(0))
        chosen = F.coalesce(free, F.get(x["candidates"], F.lit(0)))
        now = F.when(chosen.isNull(), seen["used"]).otherwise(F.array_union(seen["used"], F.array(chosen)))
        return F.struct(now.alias("used"), F.concat(seen["out"], F.array(F.struct(x["character_id"].alias("character_id"), chosen.alias("chosen")))).alias("out"))

    taken = pooled.select("book_id", F.explode(F.aggregate("cast", start, choose)["out"]).alias("x")).select("book_id", "x.*")
    told = ready.join(taken, ["book_id", "character_id"], "left")
    return told.select("book_id", "character_id", "name", F.coalesce("voice_id", "chosen", F.get("candidates", F.lit(0))).alias("voice_id"))


def seed_voices(existing: DataFrame) -> DataFrame:
    """Existing voices and the catalogue's missing ones."""
    wanted = catalogue(existing.sparkSession).select("voice_id", "name", F.lit("CATALOGUE").alias("kind"), "gender")
    return existing.select("voice_id", "name", "kind", "gender").unionByName(wanted.join(existing.select("voice_id"), "voice_id", "left_anti"))
