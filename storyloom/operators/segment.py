"""Segmentation of chapters into narration and dialogue spans, prompt lines, and chunks within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X


def _pieces(text: Column, profile: str) -> Column:
    """Alternating narration and dialogue, starting with narration.

    One replacement marks the borders; only a text that holds the mark itself is searched twice, for what is said and what lies between.
    """
    said = X.DIALOGUE[profile].replace("(?m)", "(?md)")
    marked = F.regexp_replace(text, said, X.SENTINEL + "$1" + X.SENTINEL)
    between = F.split(text, said, -1)
    searched = F.flatten(F.zip_with(between, F.regexp_extract_all(text, F.lit(said), F.lit(1)), lambda told, quoted: F.array(told, quoted)))
    return F.when(F.instr(text, X.SENTINEL) > 0, F.filter(searched, lambda piece: piece.isNotNull())).otherwise(F.split(marked, X.SENTINEL, -1))


def span_array(text: Column, language: Column) -> Column:
    """array<struct(index, text, is_dialogue, incise_character)>: ordered spans from 1 whose texts join to the text.

    Dash lines of French are parted from their speech tag, which narration reads. An empty text is one empty narration span.
    """
    body = F.coalesce(text, F.lit(""))
    part = lambda t, said, name: F.struct(t.alias("text"), said.alias("is_dialogue"), name.cast("string").alias("incise_character"))
    nobody = F.lit(None)

    def french(piece: Column, n: Column) -> Column:
        said = n % 2 == 1
        head, tail, name = X.incise(piece)
        tagged = said & X.is_dash_line(piece) & (X.strip(head) != "") & (X.strip(tail) != "")
        return F.when(tagged, F.array(part(head, F.lit(True), name), part(tail, F.lit(False), nobody))).otherwise(F.array(part(piece, said, nobody)))

    def english(piece: Column, n: Column) -> Column:
        return F.array(part(piece, n % 2 == 1, nobody))

    parts = F.when(X.language_profile(language) == "fr", F.transform(_pieces(body, "fr"), french)).otherwise(F.transform(_pieces(body, "en"), english))
    kept = F.filter(F.flatten(parts), lambda s: s["text"] != "")
    whole = F.when(body == "", F.array(part(body, F.lit(False), nobody))).otherwise(kept)
    return F.transform(whole, lambda s, i: F.struct((i + 1).alias("index"), s["text"].alias("text"), s["is_dialogue"].alias("is_dialogue"), s["incise_character"].alias("incise_character")))


def spans(chapters: DataFrame, key: str = "chapter_id", text: str = "raw_text", language: str = "language") -> DataFrame:
    """(key, index, text, is_dialogue, incise_character): the spans of each chapter, without a shuffle."""
    # The outer form: for the inner one Spark infers a filter on the array's size, and computes the array twice.
    return chapters.select(key, F.explode_outer(span_array(F.col(text), F.col(language))).alias("s")).select(key, "s.*")


def segments(chapters: DataFrame, key: str = "chapter_id", text: str = "raw_text", language: str = "language") -> DataFrame:
    """(key, position, index, text, segment_type): spans that have something to read, numbered anew; index is the span's own."""
    kind = lambda s: F.when(s["is_dialogue"], "DIALOGUE").otherwise("NARRATION")
    spoken = F.transform(span_array(F.col(text), F.col(language)), lambda s: F.struct(s["index"].alias("index"), X.spoken_text(s["text"], s["is_dialogue"]).alias("text"), kind(s).alias("segment_type")))
    placed = chapters.select(key, F.posexplode_outer(F.filter(spoken, lambda s: s["text"] != "")).alias("i", "s")).where("i is not null")
    return placed.select(key, (F.col("i") + 1).alias("position"), "s.index", "s.text", "s.segment_type")


#: Heads the names that earlier chapters have brought.
KNOWN = "Cast so far: "


def prompts(chapters: DataFrame, key: str = "chapter_id", text: str = "raw_text", language: str = "language", known: str | None = None) -> DataFrame:
    """(key, prompt): one line for each span that is not blank, with the span's own index; before them, where the column `known`
    has names, a line with those that earlier chapters have brought."""
    shown = F.transform(span_array(F.col(text), F.col(language)), lambda s: F.struct(s["index"].alias("index"), s["is_dialogue"].alias("said"), X.collapse(s["text"]).alias("shown")))
    line = lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit("]["), F.when(s["said"], "DIALOGUE").otherwise("NARRATION"), F.lit("] "), s["shown"])
    lines = F.transform(F.filter(shown, lambda s: s["shown"] != ""), line)
    if known is not None:
        head = F.concat(F.lit(KNOWN), F.array_join(known, ", "), F.lit("."))
        lines = F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, F.concat(F.array(head), lines)).otherwise(lines)
    return chapters.select(key, F.array_join(lines, "\n").alias("prompt"))


def _packed(parts: Column, sep: str, budget: int, refine) -> Column:
    """Greedy packing of parts by the sum of their estimates; a part over the budget closes the pack and is refined."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, part: Column) -> Column:
        n = X.estimate_tokens(part)
        closed = F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], sep)))).otherwise(acc["done"])
        state = lambda done, open_, size: F.struct(done.alias("done"), open_.alias("open"), size.cast("int").alias("size"))
        return (
            F.when(n > budget, state(F.concat(closed, refine(part)), F.array().cast("array<string>"), F.lit(0)))
            .when((acc["size"] + n > budget) & (F.size(acc["open"]) > 0), state(closed, F.array(part), n))
            .otherwise(state(acc["done"], F.concat(acc["open"], F.array(part)), acc["size"] + n))
        )

    return F.aggregate(parts, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], sep)))).otherwise(acc["done"]))


def chunks(chapters: DataFrame, budget: int, key: str = "chapter_id", text: str = "raw_text") -> DataFrame:
    """(key, chunk, text): paragraphs packed into a token budget, oversized ones by line; a text within it stays whole."""
    lit = F.col(text)
    parts = lambda t, sep: F.filter(F.split(t, sep, -1), lambda p: X.strip(p) != "")
    by_line = lambda part: _packed(parts(part, "\n"), "\n", budget, lambda line: F.array(line))
    packed = _packed(parts(lit, "\n\n"), "\n\n", budget, by_line)
    whole = F.when(X.estimate_tokens(lit) <= budget, F.array(lit)).when(F.size(packed) == 0, F.array(lit)).otherwise(packed)
    return chapters.select(key, F.posexplode_outer(whole).alias("i", "text")).where("i is not null").select(key, (F.col("i") + 1).alias("chunk"), "text")


def merge_casts(cast: DataFrame, key: str = "chapter_id") -> DataFrame:
    """(key, name, ...): of each name its first sighting by (chunk, ord), with the traits seen there."""
    rest = [c for c in cast.columns if c not in (key, "name")]
    first = F.min_by(F.struct(*rest), F.struct("chunk", "ord"))
    return cast.groupBy(key, "name").agg(first.alias("f")).select(key, "name", "f.*")


def known_names(cast: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, position, known): the names that earlier chapters of the book have brought, in the order of their first sighting.

    cast: book_id, position, ord, name; chapters: book_id, position. A chapter's new names are gathered before they run on.
    """
    first = cast.groupBy("book_id", "name").agg(F.min(F.struct("position", "ord")).alias("at"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("at.ord", "name"))), lambda x: x["name"])
    new = first.groupBy("book_id", F.col("at.position").alias("position")).agg(named.alias("names"))
    before = Window.partitionBy("book_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    joined = chapters.select("book_id", "position").distinct().join(new, ["book_id", "position"], "left")
    return joined.select("book_id", "position", F.flatten(F.collect_list("names").over(before)).alias("known"))


def known_cast(cast: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, position, n_known): how many names of the book earlier chapters have brought.

    Each name counts from its first chapter on; first sightings are summed by chapter before the running sum.
    """
    first = cast.groupBy("book_id", "name").agg(F.min("position").alias("position"))
    new = first.groupBy("book_id", "position").agg(F.count("*").alias("n"))
    before = Window.partitionBy("book_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    joined = chapters.join(new, ["book_id", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.select("book_id", "position", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_known"))
