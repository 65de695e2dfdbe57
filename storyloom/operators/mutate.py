"""Changes as functions from snapshots to snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.staging import stage


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set only the fields that a change sends: changes has, for each column c, c and has_c; a sent null clears. One change a key."""
    sent = changes.dropDuplicates([key]).select(key, *[F.col(c).alias(f"new_{c}") for c in columns], *[f"has_{c}" for c in columns])
    joined = table.join(sent, key, "left")
    return joined.select(*[F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def accept_merges(segments: DataFrame, characters: DataFrame, suggestions: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accept pending suggestions that share no character: segments, characters, suggestions afterwards.

    Where an earlier one, by suggestion_id, would merge away a character of a later one, the later is rejected. One that would
    merge away an earlier one's survivor stays pending: accept_all_merges() follows such chains.
    """
    asked = suggestions.where("status = 'PENDING'").join(accepted.select("suggestion_id").distinct(), "suggestion_id", "left_semi")
    ends = asked.select("suggestion_id", F.explode(F.array_distinct(F.array("survivor_id", "merged_id"))).alias("character_id"))
    losers = ends.join(asked.select(F.col("merged_id").alias("character_id"), F.col("suggestion_id").alias("other")), "character_id").where("other < suggestion_id")
    winners = asked.join(losers.select("suggestion_id"), "suggestion_id", "left_anti")
    later = winners.select(F.col("suggestion_id").alias("other"), F.col("survivor_id").alias("character_id"))
    chained = winners.select("suggestion_id", F.col("merged_id").alias("character_id")).join(later, "character_id").where("other < suggestion_id").select("suggestion_id")
    taken = winners.join(chained, "suggestion_id", "left_anti")
    moves = taken.select(F.col("merged_id").alias("character_id"), F.col("survivor_id").alias("to_id"))
    moved = segments.join(moves, "character_id", "left").select(*[F.coalesce("to_id", "character_id").alias("character_id") if c == "character_id" else F.col(c) for c in segments.columns])
    kept = characters.join(moves.select("character_id"), "character_id", "left_anti")
    gone = moves.select(F.col("character_id").alias("gone"))
    touched = suggestions.where("status = 'PENDING'").select("suggestion_id", F.explode(F.array("survivor_id", "merged_id")).alias("gone")).join(gone, "gone", "left_semi").select("suggestion_id").distinct()
    marks = taken.select("suggestion_id", F.lit("ACCEPTED").alias("now")).unionByName(touched.join(taken.select("suggestion_id"), "suggestion_id", "left_anti").select("suggestion_id", F.lit("REJECTED").alias("now")))
    after = suggestions.join(marks, "suggestion_id", "left").select(*[F.coalesce("now", "status").alias("status") if c == "status" else F.col(c) for c in suggestions.columns])
    return moved, kept, after


def accept_all(suggestions: DataFrame) -> DataFrame:
    """(book_id, suggestion_id, status) when a book's pending suggestions are accepted one after another, by suggestion_id.

    A suggestion whose character an earlier accepted one has merged away is rejected. So it is settled as soon as the earlier
    ones that would merge away either of its characters are: each round settles, in all books at once, those that no open one
    can still touch. Rounds are joins on characters, as many as the longest chain of suggestions that hang on each other; no
    book meets in one task. Settled suggestions leave the rounds.
    """
    settled = [suggestions.where("status <> 'PENDING'").select("book_id", "suggestion_id", "status")]
    pending = stage(suggestions.where("status = 'PENDING'").select("book_id", "suggestion_id", "survivor_id", "merged_id"), "accept-open")
    # (suggestion, earlier one that would merge one of its characters away)
    touched = pending.select("book_id", "suggestion_id", F.explode(F.array_distinct(F.array("survivor_id", "merged_id"))).alias("character_id"))
    taker = pending.select("book_id", F.col("suggestion_id").alias("earlier"), F.col("merged_id").alias("character_id"))
    waits = touched.join(taker, ["book_id", "character_id"]).where(F.col("earlier") < F.col("suggestion_id")).select("book_id", "suggestion_id", "earlier").distinct()
    waits, open_ = stage(waits, "accept-waits"), pending.select("book_id", "suggestion_id")
    while True:
        # Nothing earlier left to wait for: accepted.
        fresh = stage(open_.join(waits, ["book_id", "suggestion_id"], "left_anti").withColumn("status", F.lit("ACCEPTED")), "accept-taken")
        if fresh.isEmpty():
            break
        before = fresh.select("book_id", F.col("suggestion_id").alias("earlier"))
        lost = stage(waits.join(before, ["book_id", "earlier"], "left_semi").select("book_id", "suggestion_id").distinct().withColumn("status", F.lit("REJECTED")), "accept-lost")
        now = fresh.unionByName(lost)
        settled.append(now)
        open_ = stage(open_.join(now, ["book_id", "suggestion_id"], "left_anti"), "accept-open")
        # What is rejected merges nothing, so nobody waits for it; what is settled waits no more.
        gone = now.select("book_id", F.col("suggestion_id").alias("earlier"))
        waits = stage(waits.join(gone, ["book_id", "earlier"], "left_anti").join(now, ["book_id", "suggestion_id"], "left_anti"), "accept-waits")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def final_survivors(moves: DataFrame) -> DataFrame:
    """(character_id, to_id): where each merged character ends, by pointer jumping: each round doubles the way that a pointer goes.

    moves: character_id (once), to_id; without circles, as accepting in order gives it.
    """
    moves = stage(moves.select("character_id", "to_id"), "merge-moves")
    while True:
        onward = moves.select(F.col("character_id").alias("to_id"), F.col("to_id").alias("next_id"))
        jumped = stage(moves.join(onward, "to_id", "left").select("character_id", F.coalesce("next_id", "to_id").alias("to_id"), F.col("next_id").isNotNull().alias("moved")), "merge-moves")
        moves = jumped.select("character_id", "to_id")
        if jumped.where("moved").isEmpty():
            return moves


def accept_all_merges(segments: DataFrame, characters: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, characters and suggestions after all pending suggestions are accepted in order: lines go to the last survivor of a chain."""
    now = stage(accept_all(suggestions), "accept-all")
    taken = suggestions.where("status = 'PENDING'").join(now.where("status = 'ACCEPTED'"), ["book_id", "suggestion_id"], "left_semi")
    moves = final_survivors(taken.select(F.col("merged_id").alias("character_id"), F.col("survivor_id").alias("to_id")))
    moved = segments.join(moves, "character_id", "left").select(*[F.coalesce("to_id", "character_id").alias("character_id") if c == "character_id" else F.col(c) for c in segments.columns])
    kept = characters.join(moves.select("character_id"), "character_id", "left_anti")
    after = suggestions.drop("status").join(now, ["book_id", "suggestion_id"]).select(*suggestions.columns)
    return moved, kept, after


def name_suggestions(suggested: DataFrame, characters: DataFrame) -> DataFrame:
    """(book_id, survivor_id, merged_id): suggestions by name whose two names are both cast and differ."""
    by_name = characters.select("book_id", "name", "character_id")
    one = suggested.where(F.col("survivor_name") != F.col("merged_name")).join(by_name.withColumnsRenamed({"name": "survivor_name", "character_id": "survivor_id"}), ["book_id", "survivor_name"])
    return one.join(by_name.withColumnsRenamed({"name": "merged_name", "character_id": "merged_id"}), ["book_id", "merged_name"]).select("book_id", "survivor_id", "merged_id")


def select_takes(takes: DataFrame, chosen: DataFrame) -> DataFrame:
    """In the segments of the chosen takes these are selected and all others are not; other segments stay. Of two chosen takes of
    a segment the one with the larger id counts."""
    picked = chosen.groupBy("segment_id").agg(F.max("take_id").alias("chosen_id"))
    joined = takes.join(picked, "segment_id", "left")
    now = F.when(F.col("chosen_id").isNotNull(), F.col("take_id") == F.col("chosen_id")).otherwise(F.col("is_selected"))
    return joined.select(*[now.alias("is_selected") if c == "is_selected" else F.col(c) for c in takes.columns])


def clear_voice(characters: DataFrame, voice_id: str) -> DataFrame:
    return characters.withColumn("voice_id", F.when(F.col("voice_id") == voice_id, None).otherwise(F.col("voice_id")))


def delete_books(gone: DataFrame, chapters: DataFrame, segments: DataFrame, characters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters, segments and characters that are left when books go."""
    books = gone.select("book_id").distinct()
    left = chapters.join(books, "book_id", "left_anti")
    dead = chapters.join(books, "book_id", "left_semi").select("chapter_id")
    return left, segments.join(dead, "chapter_id", "left_anti"), characters.join(books, "book_id", "left_anti")


def delete_everything(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of books, chapters, segments, takes, characters and suggestions when books go with all that hangs on them."""
    books = gone.select("book_id").distinct()
    dead_chapters = tables["chapters"].join(books, "book_id", "left_semi").select("chapter_id")
    dead_segments = tables["segments"].join(dead_chapters, "chapter_id", "left_semi").select("segment_id")
    left = {name: tables[name].join(books, "book_id", "left_anti") for name in ("books", "chapters", "characters", "suggestions")}
    return left | {"segments": tables["segments"].join(dead_chapters, "chapter_id", "left_anti"), "takes": tables["takes"].join(dead_segments, "segment_id", "left_anti")}


def stop_chapters(chapters: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked chapters that are being generated get a wish to stop, which the run reads; others get an `error`. The status stays."""
    joined = chapters.join(asked.select("chapter_id", F.lit(True).alias("asked")).distinct(), "chapter_id", "left")
    hit, busy = F.coalesce("asked", F.lit(False)), F.col("status") == "GENERATING"
    error = F.when(hit & ~busy, F.concat(F.lit("not being generated: "), F.col("status")))
    return joined.select(*[(F.col(c) | (hit & busy)).alias(c) if c == "cancel_requested" else F.col(c) for c in chapters.columns], error.alias("error"))


def analysis_plan(books: DataFrame, chapters: DataFrame, segments: DataFrame, force: Column) -> DataFrame:
    """(book_id, resume, done, left): a book that failed and has chapters goes on with those that have no segment, unless forced; any
    other book starts anew with all of them."""
    has = chapters.join(segments.select("chapter_id").distinct().withColumn("has", F.lit(1)), "chapter_id", "left")
    counted = has.groupBy("book_id").agg(F.count("*").alias("chapters"), F.count("has").alias("analysed"))
    joined = books.join(counted, "book_id", "left")
    resume = (F.col("status") == "FAILED") & ~force & (F.coalesce("chapters", F.lit(0)) > 0)
    done = F.when(resume, F.col("analysed")).otherwise(0)
    return joined.select("book_id", resume.alias("resume"), done.cast("long").alias("done"), (F.coalesce("chapters", F.lit(0)) - done).cast("long").alias("left"))


def reconcile(books: DataFrame) -> DataFrame:
    """After a restart no book is in work: such books failed, in the stage that their status tells."""
    stuck = F.col("status").isin("PROCESSING", "GENERATING")
    stage = F.when(F.col("status") == "PROCESSING", "analysis").when(F.col("status") == "GENERATING", "generation")
    return books.withColumn("failed_stage", F.when(stuck, stage)).withColumn("status", F.when(stuck, "FAILED").otherwise(F.col("status")))


def reconcile_chapters(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("status", F.when(F.col("status") == "GENERATING", "PENDING").otherwise(F.col("status")))


def enqueue_all(chapters: DataFrame) -> DataFrame:
    """Queue every chapter that is neither done nor in work; the status stays."""
    return chapters.withColumn("queued", F.col("queued") | ~F.col("status").isin("DONE", "GENERATING"))


def force_reset(chapters: DataFrame, force: Column) -> DataFrame:
    return chapters.withColumn("status", F.when(force & (F.col("status") == "DONE"), "PENDING").otherwise(F.col("status")))


def replace_suggestions(old: DataFrame, new: DataFrame, books: DataFrame) -> DataFrame:
    """New suggestions take the place of the pending ones of their books; resolved ones stay."""
    kept = old.join(books.select("book_id"), "book_id", "left_semi").where("status <> 'PENDING'").unionByName(old.join(books.select("book_id"), "book_id", "left_anti"))
    return kept.unionByName(new)


def reject_merges(suggestions: DataFrame, rejected: DataFrame) -> DataFrame:
    """Suggestions afterwards, with `error` where one that is resolved already was to be rejected."""
    joined = suggestions.join(rejected.select("suggestion_id", F.lit(True).alias("asked")).distinct(), "suggestion_id", "left")
    asked, pending = F.coalesce("asked", F.lit(False)), F.col("status") == "PENDING"
    error = F.when(asked & ~pending, F.concat(F.lit("already "), F.lower("status")))
    return joined.select(*[F.when(asked & pending, "REJECTED").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in suggestions.columns], error.alias("error"))


def wipe_for_analysis(anew: DataFrame, segments: DataFrame, characters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of the chapters to analyse go; so do the casts of their books, but for those that resume. anew: book_id, chapter_id, resume."""
    left = segments.join(anew.select("chapter_id"), "chapter_id", "left_anti")
    return left, characters.join(anew.where("not resume").select("book_id").distinct(), "book_id", "left_anti")


def patch_voices(characters: DataFrame, wanted: DataFrame, assignable: DataFrame) -> DataFrame:
    """Characters with the wanted voice (character_id, new_voice), or with `error` and their old one where it is not assignable."""
    valid = wanted.join(assignable.select(F.col("voice_id").alias("new_voice"), F.lit(True).alias("valid")).distinct(), "new_voice", "left")
    joined = characters.join(valid, "character_id", "left")
    fits = F.coalesce("valid", F.lit(False))
    voice = F.when(fits, F.col("new_voice")).otherwise(F.col("voice_id"))
    error = F.when(F.col("new_voice").isNotNull() & ~fits, F.concat(F.lit("invalid voice "), F.col("new_voice")))
    return joined.select(*[voice.alias("voice_id") if c == "voice_id" else F.col(c) for c in characters.columns], error.alias("error"))


def add_clones(asked: DataFrame, voices: DataFrame) -> DataFrame:
    """(ord, voice_id, name, error) for each asked name: its slug, an error where a voice or an earlier request (by ord) has it."""
    slugged = asked.withColumn("voice_id", X.slug(F.col("name")))
    first = slugged.groupBy("voice_id").agg(F.min("ord").alias("first"))
    joined = slugged.join(first, "voice_id").join(voices.select("voice_id", F.lit(True).alias("there")).distinct(), "voice_id", "left")
    taken = F.coalesce("there", F.lit(False)) | (F.col("ord") > F.col("first"))
    return joined.select("ord", "voice_id", "name", F.when(taken, "a voice with this id exists").alias("error"))


def enqueue_some(chapters: DataFrame, asked: DataFrame) -> DataFrame:
    """Queue the asked chapters, whatever their status but GENERATING; the status stays."""
    joined = chapters.join(asked.select("chapter_id", F.lit(True).alias("asked")).distinct(), "chapter_id", "left")
    now = F.col("queued") | (F.coalesce("asked", F.lit(False)) & (F.col("status") != "GENERATING"))
    return joined.select(*[now.alias("queued") if c == "queued" else F.col(c) for c in chapters.columns])


def claim(chapters: DataFrame, taken: DataFrame) -> DataFrame:
    """The taken chapters are in work: out of the queue, without an error or a wish to stop."""
    joined = chapters.join(taken.select("chapter_id", F.lit(True).alias("taken")).distinct(), "chapter_id", "left")
    hit = F.coalesce("taken", F.lit(False))
    now = {"status": F.lit("GENERATING"), "queued": F.lit(False), "cancel_requested": F.lit(False), "error_message": F.lit(None).cast("string")}
    return joined.select(*[F.when(hit, now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in chapters.columns])


def stop_books(books: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked books that are in work fail in their stage; others get an `error`."""
    joined = books.join(asked.select("book_id", F.lit(True).alias("asked")).distinct(), "book_id", "left")
    hit, busy = F.coalesce("asked", F.lit(False)), F.col("status").isin("PROCESSING", "GENERATING")
    stage = F.when(hit & busy, F.when(F.col("status") == "PROCESSING", "analysis").otherwise("generation"))
    error = F.when(hit & ~busy, F.concat(F.lit("not in progress: "), F.col("status")))
    return joined.select(*[F.when(hit & busy, "FAILED").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in books.columns], stage.alias("failed_stage"), error.alias("error"))
