"""Queries over chunk merging, takes, voices and requests, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import labels, library, mutate, synthesis, timeline
from storyloom.plans.queries import query
from storyloom.plans.views import view

@query("chunk_renumber", "timeline", "SELECT chapter_id, position AS part_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY position % 3, position) AS INTEGER) AS position FROM timeline")
def chunk_renumber(spark, d):
    parts = view(spark, d, "timeline").select("chapter_id", (F.col("position") % 3).alias("chunk"), "position", F.col("position").alias("part_id"))
    return synthesis.renumber(parts).select("chapter_id", "part_id", "position")


_SEEN = "SELECT o_custkey AS book_id, o_orderkey % 7 AS chunk, o_orderkey AS ord, 'name ' || CAST(o_orderkey % 9 AS VARCHAR) AS name, o_orderpriority AS tone FROM orders"


@query("cast_persist", "", f"""WITH seen AS ({_SEEN}), have AS (SELECT DISTINCT book_id, name FROM seen WHERE (ord + book_id) % 4 = 0)
SELECT book_id, name, chunk, ord, tone FROM (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY chunk, ord) AS r FROM seen WHERE (book_id, name) NOT IN (SELECT (book_id, name) FROM have)) WHERE r = 1""")
def cast_persist(spark, d):
    seen = spark.sql(_SEEN.replace("FROM orders", "FROM {t}").replace("VARCHAR", "STRING"), t=spark.read.parquet(f"{d}/orders.parquet"))
    have = seen.where("(ord + book_id) % 4 = 0").select("book_id", "name").distinct()
    return synthesis.new_cast(seen, have).select("book_id", "name", "chunk", "ord", "tone")


@query("script_ids", "character", """SELECT o_orderkey AS line_id, c.character_id FROM (SELECT o_orderkey, o_custkey % 25 AS book_id, CASE WHEN o_orderkey % 3 > 0 THEN 'Customer#' || lpad(CAST(o_orderkey % 700 AS VARCHAR), 9, '0') END AS n FROM orders) o LEFT JOIN character c ON c.book_id = o.book_id AND c.name = o.n""")
def script_ids(spark, d):
    name = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") % 700).cast("string"), 9, "0")))
    lines = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("line_id"), (F.col("o_custkey") % 25).alias("book_id"), name.alias("character_name"))
    return synthesis.with_character_ids(lines, view(spark, d, "character")).select("line_id", "character_id")


@query("speech_locale", "", "SELECT doc_id, CASE WHEN lang LIKE 'en%' THEN 'en-US' ELSE 'fr-FR' END AS locale, CASE WHEN lang LIKE 'en%' THEN 'English' ELSE 'French' END AS language FROM documents")
def speech_locale(spark, d):
    lang = F.col("lang")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", synthesis.locale_of(lang).alias("locale"), synthesis.language_name(lang).alias("language"))


_MAP = [(loc, voice, f"{loc}/{voice}") for loc in ("fr-FR", "en-US") for voice in ("male_0", "narrator")]


@query("voice_physical", "character", f"""SELECT character_id, l AS locale, m.physical, CASE WHEN m.physical IS NULL THEN 'unknown voice ' || c.voice_id END AS error FROM (SELECT character_id, voice_id, CASE WHEN character_id % 2 = 0 THEN 'en-US' ELSE 'fr-FR' END AS l FROM character WHERE voice_id IS NOT NULL) c
LEFT JOIN (VALUES {", ".join(map(repr, _MAP))}) m(locale, voice_id, physical) ON m.locale = c.l AND m.voice_id = c.voice_id""")
def voice_physical(spark, d):
    locale = F.element_at(F.array(F.lit("en-US"), F.lit("de-DE")), (F.col("character_id") % 2 + 1).cast("int"))
    lines = view(spark, d, "character").where("voice_id is not null").select("character_id", "voice_id", locale.alias("locale"))
    mapping = spark.createDataFrame(_MAP, "locale string, voice_id string, physical string")
    return synthesis.physical_voices(lines, mapping, "fr-FR").select("character_id", "locale", "physical", "error")


_REFERENCES = [("male_0", None), ("clone-x", "voices/clone-x/ref.wav")]


@query("synthesis_turns", "segment character", """, t AS (SELECT s.segment_id, s.chapter_id, s.position, CASE WHEN s.segment_type = 'DIALOGUE' AND s.character_id IS NOT NULL THEN coalesce(c.voice_id, 'narrator') ELSE 'narrator' END AS v FROM segment s LEFT JOIN character c USING (character_id))
SELECT segment_id, CASE WHEN v = 'clone-x' THEN 'voices/clone-x/ref.wav' END AS reference_path, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY v = 'clone-x', position) AS INTEGER) AS turn FROM t""")
def synthesis_turns(spark, d):
    voices = spark.createDataFrame(_REFERENCES, "voice_id string, reference_audio_path string")
    lines = library.transcript(view(spark, d, "segment"), view(spark, d, "character"))
    return synthesis.synthesis_order(lines, voices).select("segment_id", "reference_path", "turn")


@query("used_voices", "character", "SELECT book_id, array_to_string(list_sort(list_distinct(list_append(list(voice_id) FILTER (voice_id IS NOT NULL), 'narrator'))), ',') AS voices FROM character GROUP BY book_id")
def used_voices(spark, d):
    return synthesis.used_voices(view(spark, d, "character")).select("book_id", F.array_join("voices", ",").alias("voices"))


@query("merge_prompt", "character", f"""SELECT book_id, '{synthesis.MERGE_QUESTION}' || chr(10) || string_agg(concat_ws(' | ', name, gender, age_category, nullif(tone, '')), chr(10) ORDER BY character_id) AS prompt FROM character GROUP BY book_id HAVING count(*) > 1""")
def merge_prompt(spark, d):
    return synthesis.merge_prompts(view(spark, d, "character").withColumnRenamed("tone", "description"))


_MERGES = """SELECT character_id AS reply_id, book_id, CASE WHEN character_id % 7 = 0 THEN 'no json' ELSE '{"merges": [7, {"survivor_name": "' || name || '", "merged_name": "Customer#' || lpad(CAST(character_id + 25 AS VARCHAR), 9, '0') || '", "reason": "r"}, {"survivor_name": "' || name || '", "merged_name": "' || name || '"}, {"survivor_name": "' || name || '"}]}' END AS raw FROM character"""


@query("merge_parse", "character", """SELECT a.character_id AS reply_id, a.name AS survivor_name, b.name AS merged_name, 'r' AS reason FROM character a JOIN character b ON b.name = 'Customer#' || lpad(CAST(a.character_id + 25 AS VARCHAR), 9, '0') WHERE a.character_id % 7 <> 0""")
def merge_parse(spark, d):
    cast = view(spark, d, "character")
    replies = spark.sql(_MERGES.replace("{", "{{").replace("}", "}}").replace("FROM character", "FROM {t}").replace("VARCHAR", "STRING"), t=cast)
    known = replies.select("reply_id").join(cast.select(F.col("character_id").alias("reply_id"), "name"), "reply_id").unionByName(cast.select((F.col("character_id") - 25).alias("reply_id"), "name"))
    return labels.merges(replies, known, key="reply_id").select("reply_id", "survivor_name", "merged_name", "reason")


@query("merge_reject", "suggestion", "SELECT suggestion_id, CASE WHEN suggestion_id % 5 = 0 OR suggestion_id % 10 = 9 THEN 'REJECTED' ELSE status END AS status, CASE WHEN suggestion_id % 5 = 0 AND status <> 'PENDING' THEN 'already ' || lower(status) END AS error FROM suggestion")
def merge_reject(spark, d):
    suggestions = view(spark, d, "suggestion")
    return mutate.reject_merges(suggestions, suggestions.where("suggestion_id % 5 = 0")).select("suggestion_id", "status", "error")


@query("analysis_wipe", "chapter segment character", """, anew AS (SELECT book_id, chapter_id, book_id % 2 = 0 AS resume FROM chapter WHERE chapter_id % 3 = 0)
SELECT 'segment' AS kind, segment_id AS id FROM segment WHERE chapter_id NOT IN (SELECT chapter_id FROM anew) UNION ALL SELECT 'character', character_id FROM character WHERE book_id NOT IN (SELECT book_id FROM anew WHERE NOT resume AND book_id IS NOT NULL)""")
def analysis_wipe(spark, d):
    anew = view(spark, d, "chapter").where("chapter_id % 3 = 0").select("book_id", "chapter_id", (F.col("book_id") % 2 == 0).alias("resume"))
    segments, cast = mutate.wipe_for_analysis(anew, view(spark, d, "segment"), view(spark, d, "character"))
    return segments.select(F.lit("segment").alias("kind"), F.col("segment_id").alias("id")).unionByName(cast.select(F.lit("character").alias("kind"), F.col("character_id").alias("id")))


@query("voice_patch", "character", """SELECT character_id, CASE WHEN character_id % 4 = 0 THEN 'female_1' ELSE voice_id END AS voice_id, CASE WHEN character_id % 4 = 1 THEN 'invalid voice narrator' END AS error FROM character""")
def voice_patch(spark, d):
    from storyloom.operators import cast

    characters = view(spark, d, "character")
    wanted = characters.where("character_id % 4 < 2").select("character_id", F.when(F.col("character_id") % 4 == 0, "female_1").otherwise("narrator").alias("new_voice"))
    have = spark.createDataFrame([("clone-x", "X", "CLONED", None)], "voice_id string, name string, kind string, gender string")
    return mutate.patch_voices(characters, wanted, library.assignable_voices(cast.seed_voices(have))).select("character_id", "voice_id", "error")


@query("clone_add", "", """WITH a AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'Clone X' ELSE p_name END AS name FROM part), s AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS v FROM a)
SELECT ord, v AS voice_id, CASE WHEN v = 'clone-x' OR ord > min(ord) OVER (PARTITION BY v) THEN 'a voice with this id exists' END AS error FROM s""")
def clone_add(spark, d):
    asked = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 5 == 0, "Clone X").otherwise(F.col("p_name")).alias("name"))
    have = spark.createDataFrame([("clone-x",)], "voice_id string")
    return mutate.add_clones(asked, have).select("ord", "voice_id", "error")


@query("queue_some", "queue_chapter", "SELECT chapter_id, queued OR (chapter_id % 2 = 0 AND status <> 'GENERATING') AS queued FROM queue_chapter")
def queue_some(spark, d):
    chapters = view(spark, d, "queue_chapter")
    return mutate.enqueue_some(chapters, chapters.where("chapter_id % 2 = 0")).select("chapter_id", "queued")


@query("queue_claim", "queue_chapter", "SELECT chapter_id, CASE WHEN hit THEN 'GENERATING' ELSE status END AS status, queued AND NOT hit AS queued, NOT hit AND chapter_id % 2 = 0 AS cancel_requested, CASE WHEN NOT hit THEN 'old' END AS error_message FROM (SELECT *, status = 'PENDING' AND priority = 5 AS hit FROM queue_chapter)")
def queue_claim(spark, d):
    chapters = view(spark, d, "queue_chapter").withColumn("cancel_requested", F.col("chapter_id") % 2 == 0).withColumn("error_message", F.lit("old"))
    return mutate.claim(chapters, chapters.where("status = 'PENDING' and priority = 5")).select("chapter_id", "status", "queued", "cancel_requested", "error_message")


@query("book_stop", "book", """SELECT book_id, CASE WHEN book_id % 2 = 0 AND status IN ('PROCESSING', 'GENERATING') THEN 'FAILED' ELSE status END AS status, CASE WHEN book_id % 2 = 0 THEN CASE status WHEN 'PROCESSING' THEN 'analysis' WHEN 'GENERATING' THEN 'generation' END END AS failed_stage,
CASE WHEN book_id % 2 = 0 AND status NOT IN ('PROCESSING', 'GENERATING') THEN 'not in progress: ' || status END AS error FROM book""")
def book_stop(spark, d):
    books = view(spark, d, "book")
    return mutate.stop_books(books, books.where("book_id % 2 = 0")).select("book_id", "status", "failed_stage", "error")


@query("take_new", "segment character", """SELECT s.segment_id, CASE WHEN s.segment_id % 3 = 0 THEN 'female_2' ELSE coalesce(c.voice_id, 'narrator') END AS voice_id, 'calm' AS emotion, false AS is_selected FROM segment s LEFT JOIN character c USING (character_id)""")
def take_new(spark, d):
    segments = view(spark, d, "segment")
    asked = segments.select("segment_id", F.when(F.col("segment_id") % 3 == 0, "female_2").alias("voice_id"), F.lit("calm").alias("emotion"))
    return synthesis.new_takes(asked, segments, view(spark, d, "character"))


@query("take_regenerate", "take", """SELECT segment_id, 'old' AS voice_id, is_selected FROM take WHERE chapter_id % 3 > 0 UNION ALL SELECT DISTINCT segment_id, 'narrator', true FROM take WHERE chapter_id % 3 = 0""")
def take_regenerate(spark, d):
    takes = view(spark, d, "take").withColumn("voice_id", F.lit("old"))
    made = takes.where("chapter_id % 3 = 0").select("segment_id", F.lit("narrator").alias("voice_id")).distinct()
    return synthesis.regenerated_takes(takes, made)


@query("generate_resume", "queue_chapter", "SELECT chapter_id, status FROM queue_chapter WHERE status <> 'DONE'")
def generate_resume(spark, d):
    return library.left_to_generate(view(spark, d, "queue_chapter")).select("chapter_id", "status")


@query("cast_order", "segment character", """, n AS (SELECT c.book_id, c.character_id, c.name, count(s.segment_id) AS line_count FROM character c LEFT JOIN segment s USING (character_id) WHERE contains(lower(c.name), '1') GROUP BY ALL)
SELECT character_id, CASE WHEN line_count > 0 THEN 'main' ELSE 'silent' END AS bucket, CAST(row_number() OVER (PARTITION BY book_id, line_count > 0 ORDER BY line_count DESC, name, character_id) AS INTEGER) AS place FROM n""")
def cast_order(spark, d):
    cast = library.search_names(view(spark, d, "character"), " 1 ")
    return library.cast_order(library.cast_counts(cast, view(spark, d, "segment"))).select("character_id", "bucket", "place")


_VOICE_ROWS = "SELECT p_partkey AS voice_id, p_name AS name, p_partkey % 2 = 0 AS is_favorite, CASE p_partkey % 3 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' END AS gender, CASE WHEN p_partkey % 4 = 0 THEN 'CLONED' ELSE 'CATALOGUE' END AS kind, p_partkey % 5 = 0 AS has_sample FROM part"


@query("voice_filter", "", f"SELECT voice_id FROM ({_VOICE_ROWS}) WHERE is_favorite AND gender = 'MALE' AND NOT has_sample AND contains(lower(name), 'a')")
def voice_filter(spark, d):
    voices = spark.sql(_VOICE_ROWS.replace("FROM part", "FROM {t}"), t=spark.read.parquet(f"{d}/part.parquet"))
    return library.filter_voices(voices, favourites=True, gender="MALE", sample=False, search="A ").select("voice_id")


@query("voice_offer", "", f"SELECT 'piper' AS provider, voice_id FROM ({_VOICE_ROWS}) WHERE kind = 'CATALOGUE' UNION ALL SELECT 'qwen', voice_id FROM ({_VOICE_ROWS})")
def voice_offer(spark, d):
    voices = spark.sql(_VOICE_ROWS.replace("FROM part", "FROM {t}"), t=spark.read.parquet(f"{d}/part.parquet")).withColumn("voice_id", F.col("voice_id").cast("string"))
    one = lambda p: library.offered_voices(voices, p).select(F.lit(p).alias("provider"), F.col("voice_id").cast("long").alias("voice_id"))
    return one("piper").unionByName(one("qwen"))


_MOVED = """, q AS (SELECT * FROM queue_chapter WHERE queued), a AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY priority DESC, position, chapter_id) AS spot, count(*) OVER (PARTITION BY book_id) AS n FROM q),
m AS (SELECT book_id, chapter_id AS moved, spot AS origin, n - spot + 1 AS dest FROM a WHERE spot = 2), b AS (SELECT a.*, m.moved, m.origin, m.dest FROM a JOIN m USING (book_id)),
c AS (SELECT *, CASE WHEN chapter_id = moved THEN dest WHEN origin < dest AND spot > origin AND spot <= dest THEN spot - 1 WHEN origin > dest AND spot >= dest AND spot < origin THEN spot + 1 ELSE spot END AS now FROM b)
SELECT book_id, chapter_id, CAST(n - now + 1 AS INTEGER) AS priority FROM c WHERE n - now + 1 <> priority"""


@query("queue_move", "queue_chapter", _MOVED)
def queue_move(spark, d):
    """The second chapter of each book's queue goes to the place as far from the end."""
    from pyspark.sql import Window

    queue = view(spark, d, "queue_chapter").where("queued")
    order = [F.desc("priority"), F.asc("position"), F.asc("chapter_id")]
    w = Window.partitionBy("book_id")
    placed = queue.select("book_id", "chapter_id", F.row_number().over(w.orderBy(*order)).alias("at"), F.count("*").over(w).alias("n"))
    moves = placed.where("at = 2").select("book_id", "chapter_id", (F.col("n") - F.col("at") + 1).alias("to"))
    return timeline.moved_priorities(queue, moves, "book_id", order)


@query("analysis_progress", "chapter segment", "SELECT book_id, round(10 + count(*) FILTER (chapter_id IN (SELECT chapter_id FROM segment)) / count(*) * 50, 6) AS progress FROM chapter GROUP BY book_id")
def analysis_progress(spark, d):
    return library.analysis_progress(view(spark, d, "chapter"), view(spark, d, "segment"))
