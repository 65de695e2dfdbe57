"""Queries over the adapter views, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import cast, labels, library, mutate, segment, timeline
from storyloom.plans.views import view, with_views
from storyloom.sources import html as pages_html
from storyloom.sources import providers, wav

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# RE2 spells the patterns as Java does, but for the end of text, which both know as \z.
_WS = X.WS
_q = lambda s: s.replace("'", "''")
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+\\z', '', 'g')"

SPAN_SQL = f"""
cut AS (
  SELECT chapter_id, fr, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS piece FROM (
    SELECT chapter_id, fr, string_split(regexp_replace(raw_text, CASE WHEN fr THEN '{_q(X.DIALOGUE["fr"])}' ELSE '{_q(X.DIALOGUE["en"])}' END, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p
    FROM (SELECT *, NOT coalesce(starts_with(lower({_STRIP("language")}), 'en') OR lower({_STRIP("language")}) = 'anglais', false) AS fr FROM dialogue_text))
),
kept AS (
  SELECT *, n % 2 = 1 AS said, n % 2 = 1 AND fr AND regexp_matches(piece, '^{_WS}*[—–―]') AS dash,
         regexp_extract(piece, '{_q(X.INCISE)}', 1) AS head, regexp_extract(piece, '{_q(X.INCISE)}', 2) AS tail FROM cut WHERE piece <> ''
),
parts AS (
  SELECT chapter_id, n, 0 AS k, CASE WHEN dash AND head <> '' THEN head ELSE piece END AS text, said AS is_dialogue,
         CASE WHEN dash AND head <> '' THEN nullif(regexp_extract(tail, '{_q(X.EXPLICIT_NAME)}', 1), '') END AS incise_character FROM kept
  UNION ALL SELECT chapter_id, n, 1, tail, false, NULL FROM kept WHERE dash AND head <> ''
),
span AS (SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY n, k) AS INTEGER) AS index, text, is_dialogue, incise_character FROM parts),
bare AS (SELECT *, {_STRIP("text")} AS s FROM span),
spoken AS (
  SELECT chapter_id, index, is_dialogue, CASE WHEN NOT is_dialogue THEN s
    WHEN (starts_with(s, '«') AND ends_with(s, '»')) OR (starts_with(s, '“') AND ends_with(s, '”')) OR (starts_with(s, '"') AND ends_with(s, '"') AND length(s) > 1) THEN {_STRIP("substr(s, 2, length(s) - 2)")}
    ELSE {_STRIP(f"regexp_replace(regexp_replace(s, '^[ \\t]*[—–―]{_WS}*', ''), '{_WS}*,{_WS}*\\z', '')")} END AS text FROM bare
)"""


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = with_views(views, sql) if views else sql
        return function

    return register


# ---- segmentation, prompts, chunks -------------------------------------------------------------------------------------


@query("seg_spans", "dialogue_text", f", {SPAN_SQL.strip()} SELECT chapter_id, index, text, is_dialogue, incise_character FROM span")
def seg_spans(spark, d):
    return segment.spans(view(spark, d, "dialogue_text"))


@query("seg_counts", "dialogue_text", f""", {SPAN_SQL.strip()} SELECT chapter_id, CASE WHEN is_dialogue THEN 'DIALOGUE' ELSE 'NARRATION' END AS segment_type, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS characters
FROM spoken WHERE text <> '' GROUP BY ALL""")
def seg_counts(spark, d):
    made = segment.segments(view(spark, d, "dialogue_text"))
    return made.groupBy("chapter_id", "segment_type").agg(F.count("*").alias("segments"), F.sum(F.char_length("text")).alias("characters"))


@query("seg_segments", "dialogue_text", f""", {SPAN_SQL.strip()} SELECT chapter_id, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY index) AS INTEGER) AS position, index, text,
CASE WHEN is_dialogue THEN 'DIALOGUE' ELSE 'NARRATION' END AS segment_type FROM spoken WHERE text <> ''""")
def seg_segments(spark, d):
    return segment.segments(view(spark, d, "dialogue_text"))


@query("prompt_lines", "dialogue_text", f""", {SPAN_SQL.strip()}, shown AS (SELECT chapter_id, index, is_dialogue, {_STRIP(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS t FROM span)
SELECT chapter_id, string_agg('[' || index || '][' || CASE WHEN is_dialogue THEN 'DIALOGUE' ELSE 'NARRATION' END || '] ' || t, chr(10) ORDER BY index) AS prompt FROM shown WHERE t <> '' GROUP BY chapter_id""")
def prompt_lines(spark, d):
    return segment.prompts(view(spark, d, "dialogue_text"))


CHUNK_BUDGET = 120


@query("chunk_budget", "dialogue_text", f"""
, part AS (SELECT chapter_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM (SELECT chapter_id, list_filter(string_split(raw_text, chr(10) || chr(10)), lambda x: {_STRIP("x")} <> '') AS p FROM dialogue_text WHERE length(raw_text) // 4 > {CHUNK_BUDGET})),
line AS (
  SELECT chapter_id, i, 0 AS j, 0 AS grp, t, length(t) // 4 AS n FROM part WHERE length(t) // 4 <= {CHUNK_BUDGET}
  UNION ALL
  SELECT chapter_id, i, generate_subscripts(l, 1), i, unnest(l), 0 FROM (SELECT chapter_id, i, list_filter(string_split(t, chr(10)), lambda x: {_STRIP("x")} <> '') AS l FROM part WHERE length(t) // 4 > {CHUNK_BUDGET})
),
piece AS (SELECT chapter_id, grp, t, length(t) // 4 AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY i, j) AS r FROM line),
walk AS (
  SELECT chapter_id, r, grp, t, n, n AS size, 1 AS chunk FROM piece WHERE r = 1
  UNION ALL
  SELECT p.chapter_id, p.r, p.grp, p.t, p.n, CASE WHEN x.new THEN p.n ELSE w.size + p.n END, w.chunk + CASE WHEN x.new THEN 1 ELSE 0 END
  FROM walk w JOIN piece p ON p.chapter_id = w.chapter_id AND p.r = w.r + 1, LATERAL (SELECT p.grp <> w.grp OR w.size + p.n > {CHUNK_BUDGET} OR p.n > {CHUNK_BUDGET} OR w.n > {CHUNK_BUDGET} AS new) x
)
SELECT chapter_id, CAST(chunk AS INTEGER) AS chunk, CASE WHEN max(grp) > 0 THEN string_agg(t, chr(10) ORDER BY r) ELSE string_agg(t, chr(10) || chr(10) ORDER BY r) END AS text FROM walk GROUP BY chapter_id, chunk
UNION ALL SELECT chapter_id, 1, raw_text FROM dialogue_text WHERE length(raw_text) // 4 <= {CHUNK_BUDGET}""")
def chunk_budget(spark, d):
    return segment.chunks(view(spark, d, "dialogue_text"), CHUNK_BUDGET)


_SIGHTED = "SELECT l_orderkey % 500 AS chapter_id, l_linenumber AS chunk, l_partkey AS ord, 'name ' || CAST(l_suppkey % 20 AS VARCHAR) AS name, l_returnflag AS tone FROM lineitem"


@query("chunk_merge_cast", "", f"""SELECT chapter_id, name, chunk, ord, tone FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, name ORDER BY chunk, ord, tone) AS r FROM (SELECT DISTINCT chapter_id, chunk, ord, name, min(tone) AS tone FROM ({_SIGHTED}) GROUP BY ALL)) WHERE r = 1""")
def chunk_merge_cast(spark, d):
    seen = spark.sql(_SIGHTED.replace("FROM lineitem", "FROM {t}").replace("VARCHAR", "STRING"), t=spark.read.parquet(f"{d}/lineitem.parquet"))
    return segment.merge_casts(seen.groupBy("chapter_id", "chunk", "ord", "name").agg(F.min("tone").alias("tone"))).select("chapter_id", "name", "chunk", "ord", "tone")


@query("known_cast", "queue_chapter", """, seen AS (SELECT book_id, position, priority AS name FROM queue_chapter), first AS (SELECT book_id, name, min(position) AS position FROM seen GROUP BY ALL),
place AS (SELECT DISTINCT book_id, position FROM queue_chapter)
SELECT p.book_id, p.position, (SELECT count(*) FROM first f WHERE f.book_id = p.book_id AND f.position < p.position) AS n_known FROM place p""")
def known_cast(spark, d):
    chapters = view(spark, d, "queue_chapter")
    return segment.known_cast(chapters.select("book_id", "position", F.col("priority").alias("name")), chapters.select("book_id", "position").distinct())


# ---- scalar functions --------------------------------------------------------------------------------------------------


@query("lang_profile", "", f"""SELECT doc_id, CASE WHEN starts_with(lower({_STRIP("x")}), 'en') OR lower({_STRIP("x")}) = 'anglais' THEN 'en' ELSE 'fr' END AS profile
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN '  EN  ' WHEN 2 THEN 'Anglais' WHEN 3 THEN lang || '-XX' END AS x FROM documents)""")
def lang_profile(spark, d):
    n = F.col("doc_id") % 5
    x = F.when(n == 0, F.col("lang")).when(n == 1, "  EN  ").when(n == 2, "Anglais").when(n == 3, F.concat("lang", F.lit("-XX")))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.language_profile(x).alias("profile"))


_LOOSE = ["DIALOG, ", "narr-ator", "Monologue", "m", "Female!", "teen ager", "Young Adult", "old-ish", "???", "prose / x"]


@query("enum_coerce", "", f"""SELECT part_id, {", ".join(
    f"coalesce(CASE WHEN list_contains({X.ENUMS[e].split()}, w) THEN w END, CASE WHEN list_contains({X.ENUMS[e].split()}, f) THEN f END, "
    f"MAP {{{', '.join(repr(k) + ': ' + repr(v) for k, v in X.ALIASES[e].items())}}}[w], "
    f"MAP {{{', '.join(repr(k) + ': ' + repr(v) for k, v in X.ALIASES[e].items())}}}[f], '{default}') AS {e}"
    for e, default in (("segment_type", "NARRATION"), ("gender", "UNKNOWN"), ("age_category", "UNKNOWN")))}
FROM (SELECT part_id, w, split_part(w, '_', 1) AS f FROM (SELECT p_partkey AS part_id, regexp_replace(regexp_replace(upper(trim({_LOOSE}[p_partkey % 10 + 1])), '[ -]+', '_', 'g'), '[^A-Z_]', '', 'g') AS w FROM part))""")
def enum_coerce(spark, d):
    loose = F.element_at(F.array(*map(F.lit, _LOOSE)), (F.col("p_partkey") % 10 + 1).cast("int"))
    kinds = (("segment_type", "NARRATION"), ("gender", "UNKNOWN"), ("age_category", "UNKNOWN"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part_id"), *[X.coerce_enum(loose, e, default).alias(e) for e, default in kinds])


@query("name_functions", "", f"""SELECT p_partkey AS part_id, regexp_matches(n, '{_q(X.PROPER_NOUN)}') AS proper, CASE WHEN s = '' THEN 'voice' ELSE s END AS slug
FROM (SELECT *, regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Mr ' || 'Élan ' || upper(left(p_name, 1)) || 'x' WHEN 2 THEN '--É--' ELSE 'Sir ' || p_name END AS n FROM part))""")
def name_functions(spark, d):
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("Mr Élan "), F.upper(F.left("p_name", F.lit(1))), F.lit("x"))).when(n == 2, "--É--").otherwise(F.concat(F.lit("Sir "), "p_name"))
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part_id"), X.is_proper_noun(name).alias("proper"), X.slug(name).alias("slug"))


@query("time_functions", "timeline", """SELECT chapter_id, position, CAST(duration_ms // 1000 // 60 AS VARCHAR) || ':' || lpad(CAST(duration_ms // 1000 % 60 AS VARCHAR), 2, '0') AS shown,
greatest(0.0::DOUBLE, CASE WHEN position % 3 = 0 THEN duration_ms / 1000 - 2.5::DOUBLE ELSE least(duration_ms / 1000 - 2.5::DOUBLE, 1.5::DOUBLE) END) AS sought FROM timeline""")
def time_functions(spark, d):
    s = F.col("duration_ms") / F.lit(1000.0)
    limit = F.when(F.col("position") % 3 != 0, F.lit(1.5))
    return view(spark, d, "timeline").select("chapter_id", "position", X.minutes_seconds(s).alias("shown"), X.seek(s, F.lit(-2.5), limit).alias("sought"))


@query("setting_chain", "book", "SELECT book_id, coalesce(nullif(tts_provider, ''), nullif('', ''), 'piper') AS tts, coalesce(nullif(language, ''), nullif(author, '')) AS language FROM book")
def setting_chain(spark, d):
    return view(spark, d, "book").select("book_id", X.first_set(F.col("tts_provider"), F.lit(""), F.lit("piper")).alias("tts"), X.first_set(F.col("language"), F.col("author")).alias("language"))


@query("token_estimates", "chapter", "SELECT chapter_id, CAST(length(raw_text) // 4 AS INTEGER) AS tokens, round(60.0::DOUBLE + (length(raw_text) // 4) / 1000.0::DOUBLE * 12.5, 6) AS timeout FROM chapter")
def token_estimates(spark, d):
    text = F.col("raw_text")
    return view(spark, d, "chapter").select("chapter_id", X.estimate_tokens(text).alias("tokens"), F.round(X.read_timeout(text, 60.0, 12.5), 6).alias("timeout"))


@query("pcm_clamp", "", "SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(greatest(-1.0, least(1.0, x::DOUBLE)) * 32767) AS INTEGER)) AS pcm FROM embeddings")
def pcm_clamp(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", X.pcm16(F.col("embedding")).alias("pcm"))


# ---- labels ------------------------------------------------------------------------------------------------------------


@query("label_declared", "reply", f"""SELECT chunk_id, CAST(o AS INTEGER) AS ord, c ->> 'name' AS name,
CASE WHEN c ->> 'gender' = 'm, ' THEN 'MALE' ELSE 'UNKNOWN' END AS gender, CASE WHEN c ->> 'age_category' = 'Old' THEN 'ELDER' ELSE 'UNKNOWN' END AS age_category, c ->> 'tone' AS tone
FROM (SELECT chunk_id, generate_subscripts(l, 1) AS o, unnest(l) AS c FROM (SELECT chunk_id, CAST(json_extract(raw, '$.characters') AS JSON[]) AS l FROM reply WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')) WHERE json_type(c) = 'OBJECT' AND c ->> 'name' <> ''""")
def label_declared(spark, d):
    return labels.declared(view(spark, d, "reply"))


@query("label_attributions", "reply", """SELECT chunk_id, CAST(o AS INTEGER) AS ord, TRY_CAST(a ->> 'index' AS BIGINT) AS index, a ->> 'character_name' AS character_name, a ->> 'emotion' AS emotion
FROM (SELECT chunk_id, generate_subscripts(l, 1) AS o, unnest(l) AS a FROM (SELECT chunk_id, CAST(json_extract(raw, '$.attributions') AS JSON[]) AS l FROM reply WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')) WHERE json_type(a) = 'OBJECT' AND TRY_CAST(a ->> 'index' AS BIGINT) IS NOT NULL""")
def label_attributions(spark, d):
    return labels.attributions(view(spark, d, "reply"))


@query("label_fold", "reply", """SELECT chunk_id, CAST(i AS BIGINT) AS index, c AS character_name, e AS emotion, g AS registered
FROM (SELECT conv_id AS chunk_id, max(turn) + 5 AS last FROM conversations WHERE conv_id % 11 NOT IN (3, 5, 7) GROUP BY conv_id),
LATERAL (VALUES (1, 'Orlan Tarn', 'calm', false), (2, 'Mara', NULL, false), (3, 'Mara', NULL, false), (4, NULL, 'glad', false), (last, 'Odile', NULL, true)) v(i, c, e, g)""")
def label_fold(spark, d):
    return labels.folded_labels(view(spark, d, "reply"))


@query("label_errors", "reply", "SELECT chunk_id, CASE WHEN chunk_id % 11 = 3 THEN 'not an object' WHEN raw IS NULL THEN 'not an object' ELSE 'not JSON' END AS error FROM reply WHERE chunk_id % 11 IN (3, 5, 7)")
def label_errors(spark, d):
    return labels.errors(view(spark, d, "reply"))


@query("label_script", "dialogue_text", f""", {SPAN_SQL.strip()},
good AS (SELECT conv_id AS chunk_id, max(turn) + 5 AS last FROM conversations WHERE conv_id % 11 NOT IN (3, 5, 7) GROUP BY conv_id),
label AS (SELECT chunk_id, CAST(i AS BIGINT) AS index, c, e FROM good, LATERAL (VALUES (1, 'Orlan Tarn', 'calm'), (2, 'Mara', NULL), (3, 'Mara', NULL), (4, NULL, 'glad'), (last, 'Odile', NULL)) v(i, c, e)),
known(ord, name, words) AS (VALUES (1, 'Orlan Tarn', ['orlan', 'tarn']), (4, 'Mara', ['mara'])),
named AS (SELECT chapter_id, index, incise_character AS said, list_filter(regexp_split_to_array(lower(incise_character), '{_WS}+'), lambda x: x <> '') AS w FROM span JOIN good ON chunk_id = chapter_id WHERE is_dialogue AND incise_character IS NOT NULL),
sure AS (SELECT chapter_id, index, arg_min(name, CASE WHEN name = said THEN 0 ELSE ord END) AS resolved FROM named JOIN known ON name = said OR len(w) > 0 AND list_has_all(words, w) OR list_has_all(w, words) GROUP BY chapter_id, index)
SELECT p.chapter_id AS chunk_id, CAST(row_number() OVER (PARTITION BY p.chapter_id ORDER BY p.index) AS INTEGER) AS position, p.text, CASE WHEN p.is_dialogue THEN 'DIALOGUE' ELSE 'NARRATION' END AS segment_type,
  CASE WHEN p.is_dialogue THEN coalesce(s.resolved, l.c) END AS character_name, CASE WHEN p.is_dialogue THEN l.e END AS emotion
FROM spoken p LEFT JOIN label l ON l.chunk_id = p.chapter_id AND l.index = p.index LEFT JOIN sure s ON s.chapter_id = p.chapter_id AND s.index = p.index WHERE p.text <> ''""")
def label_script(spark, d):
    replies = view(spark, d, "reply")
    spans = segment.spans(view(spark, d, "dialogue_text")).withColumnRenamed("chapter_id", "chunk_id")
    return labels.script(spans, labels.folded_labels(replies), labels.declared(replies))


# ---- voices ------------------------------------------------------------------------------------------------------------

_VOICES = ", ".join(f"({i}, '{v}', {'NULL' if g is None else repr(g)}, '{a}', {t}, {q})" for i, (v, g, a, t, q) in enumerate(cast.CATALOGUE))
_SCORED = f""", voice(ord, voice, voice_gender, age, tones, qualities) AS (VALUES {_VOICES}), scored AS (
  SELECT character_id, book_id, name, voice_id, gender, voice AS candidate, voice_gender, CASE WHEN voice_gender IS NULL THEN -10 ELSE
    CASE WHEN voice_gender = CASE WHEN gender = 'UNKNOWN' THEN 'NEUTRAL' ELSE gender END THEN 4 ELSE 0 END + CASE WHEN age_category <> 'UNKNOWN' AND age = age_category THEN 2 ELSE 0 END
    + CASE WHEN list_contains(tones, lower(tone)) THEN 1 ELSE 0 END + CASE WHEN list_contains(qualities, lower(voice_quality)) THEN 1 ELSE 0 END END AS score
  FROM character, voice)"""
_RANKED = _SCORED + """, ranked AS (SELECT character_id, list(candidate ORDER BY -score, candidate) AS candidates FROM scored WHERE voice_gender = CASE WHEN gender = 'UNKNOWN' THEN 'NEUTRAL' ELSE gender END GROUP BY character_id)"""


@query("voice_catalogue", "character", f""", cast_of AS (SELECT voice_id, count(*) AS n FROM character WHERE voice_id IS NOT NULL GROUP BY voice_id)
SELECT ord, voice, upper(left(voice, 1)) || replace(substr(voice, 2), '_', ' ') AS name, g AS gender, coalesce(n, 0) AS n_cast FROM (VALUES {_VOICES}) v(ord, voice, g, age, tones, qualities) LEFT JOIN cast_of ON voice_id = voice""")
def voice_catalogue(spark, d):
    """The catalogue, and how many characters each of its voices has."""
    used = view(spark, d, "character").where("voice_id is not null").groupBy("voice_id").agg(F.count("*").alias("n"))
    return cast.catalogue(spark).join(used, "voice_id", "left").select("ord", F.col("voice_id").alias("voice"), "name", "gender", F.coalesce("n", F.lit(0)).alias("n_cast"))


@query("voice_score", "character", _SCORED + " SELECT character_id, candidate, score FROM scored")
def voice_score(spark, d):
    return cast.voice_scores(view(spark, d, "character")).select("character_id", "candidate", "score")


@query("voice_rank", "character", _RANKED + " SELECT character_id, array_to_string(candidates, ',') AS candidates FROM ranked")
def voice_rank(spark, d):
    return cast.ranked_voices(view(spark, d, "character")).select("character_id", F.array_join("candidates", ",").alias("candidates"))


@query("cast_assign", "character", _RANKED + """, turn AS (SELECT c.book_id, c.character_id, c.name, c.voice_id, r.candidates, row_number() OVER (PARTITION BY c.book_id ORDER BY c.name, c.character_id) AS k FROM character c LEFT JOIN ranked r USING (character_id)),
own AS (SELECT book_id, list(DISTINCT voice_id) AS used FROM character WHERE voice_id IS NOT NULL AND voice_id <> 'narrator' GROUP BY book_id),
walk AS (
  SELECT b.book_id, 0::BIGINT AS k, NULL::BIGINT AS character_id, NULL::VARCHAR AS name, NULL::VARCHAR AS chosen, coalesce(o.used, []::VARCHAR[]) AS used FROM (SELECT DISTINCT book_id FROM character) b LEFT JOIN own o USING (book_id)
  UNION ALL
  SELECT w.book_id, t.k, t.character_id, t.name, x.v, CASE WHEN list_contains(w.used, x.v) THEN w.used ELSE list_append(w.used, x.v) END
  FROM walk w JOIN turn t ON t.book_id = w.book_id AND t.k = w.k + 1, LATERAL (SELECT coalesce(t.voice_id, list_filter(t.candidates, lambda c: NOT list_contains(w.used, c))[1], t.candidates[1]) AS v) x
)
SELECT book_id, character_id, name, chosen AS voice_id FROM walk WHERE k > 0""")
def cast_assign(spark, d):
    return cast.assign_voices(view(spark, d, "character"))


_HAVE = "SELECT DISTINCT voice_id, CASE WHEN voice_id LIKE 'clone-%' THEN 'CLONED' ELSE 'CATALOGUE' END AS kind FROM character WHERE voice_id IS NOT NULL"


def _have(spark, d):
    """The voices that the cast has, as rows of the voice table."""
    voice = F.col("voice_id")
    cast_voices = view(spark, d, "character").where(voice.isNotNull()).select("voice_id").distinct()
    return cast_voices.select("voice_id", X.humanize(voice).alias("name"), F.when(voice.startswith("clone-"), "CLONED").otherwise("CATALOGUE").alias("kind"), F.lit(None).cast("string").alias("gender"))


@query("voice_seed", "character", f", have AS ({_HAVE}) SELECT voice_id, kind FROM have UNION ALL SELECT voice, 'CATALOGUE' FROM (VALUES {_VOICES}) v(ord, voice, g, age, tones, qualities) WHERE voice NOT IN (SELECT voice_id FROM have)")
def voice_seed(spark, d):
    return cast.seed_voices(_have(spark, d)).select("voice_id", "kind")


@query("voice_hues", "", "SELECT p_brand AS voice_id, round(((row_number() OVER (ORDER BY p_brand) - 1) * 137.508) % 360.0, 3)::DOUBLE AS hue FROM (SELECT DISTINCT p_brand FROM part)")
def voice_hues(spark, d):
    """A hue for each brand, as for each voice."""
    return library.voice_hues(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("voice_id")).distinct())


@query("assignable_voices", "character", f", have AS ({_HAVE}) SELECT voice AS voice_id FROM (VALUES {_VOICES}) v(ord, voice, g, age, tones, qualities) WHERE voice <> 'narrator' UNION SELECT voice_id FROM have WHERE voice_id <> 'narrator'")
def assignable_voices(spark, d):
    return library.assignable_voices(cast.seed_voices(_have(spark, d)))


# ---- library -----------------------------------------------------------------------------------------------------------

_QUEUE = """, q AS (SELECT c.chapter_id, c.book_id, b.title, c.status, c.priority, c.position, c.status = 'GENERATING' AS generating FROM queue_chapter c JOIN book b USING (book_id) WHERE c.status = 'GENERATING' OR (c.status = 'PENDING' AND c.queued))"""


@query("queue_view", "queue_chapter book", _QUEUE + " SELECT *, CAST(row_number() OVER (PARTITION BY generating, priority, book_id ORDER BY position, chapter_id) AS INTEGER) AS place FROM q ORDER BY generating DESC, priority DESC, book_id, position, chapter_id")
def queue_view(spark, d):
    return library.ranked_queue(library.queue_view(view(spark, d, "queue_chapter"), view(spark, d, "book"))).orderBy(*library.queue_order(), "chapter_id")


@query("queue_next", "queue_chapter", "SELECT * FROM queue_chapter WHERE status = 'PENDING' AND queued ORDER BY priority DESC, position, book_id LIMIT 1")
def queue_next(spark, d):
    return library.next_chapter(view(spark, d, "queue_chapter"))


@query("queue_rerank", "queue_chapter", """SELECT book_id, chapter_id, CAST(wanted AS INTEGER) AS priority FROM (SELECT *, count(*) OVER (PARTITION BY book_id) - row_number() OVER (PARTITION BY book_id ORDER BY priority DESC, position, chapter_id) + 1 AS wanted FROM queue_chapter WHERE queued) WHERE wanted <> priority""")
def queue_rerank(spark, d):
    return timeline.changed_priorities(view(spark, d, "queue_chapter").where("queued"), "book_id", [F.desc("priority"), F.asc("position"), F.asc("chapter_id")])


@query("queue_enqueue", "queue_chapter", "SELECT chapter_id, status, queued OR status NOT IN ('DONE', 'GENERATING') AS queued FROM queue_chapter")
def queue_enqueue(spark, d):
    return mutate.enqueue_all(view(spark, d, "queue_chapter")).select("chapter_id", "status", "queued")


@query("transcript", "segment character", """SELECT s.segment_id, s.chapter_id, s.position, s.segment_type, c.name AS character_name,
CASE WHEN s.segment_type = 'DIALOGUE' AND s.character_id IS NOT NULL THEN coalesce(c.voice_id, 'narrator') ELSE 'narrator' END AS voice_id FROM segment s LEFT JOIN character c USING (character_id)""")
def transcript(spark, d):
    return library.transcript(view(spark, d, "segment"), view(spark, d, "character"))


@query("cast_counts", "segment character", "SELECT c.book_id, c.character_id, c.name, count(s.segment_id) AS line_count FROM character c LEFT JOIN segment s USING (character_id) GROUP BY ALL")
def cast_counts(spark, d):
    return library.cast_counts(view(spark, d, "character"), view(spark, d, "segment"))


@query("library_filter", "book", "SELECT book_id, title FROM book WHERE status = 'FAILED' AND tts_provider IS NULL AND (contains(lower(title), '1') OR contains(lower(coalesce(author, '')), '1'))")
def library_filter(spark, d):
    return library.filter_library(view(spark, d, "book"), status="FAILED", provider="default", search=" 1 ").select("book_id", "title")


_MODES = {"published_desc": "published_at DESC NULLS LAST", "published_asc": "published_at ASC NULLS LAST", "author": "lower(coalesce(author, ''))", "title": "lower(title)", "recent": "created_at DESC"}


@query("library_sort", "book", " UNION ALL ".join(f"SELECT '{m}' AS mode, book_id, CAST(row_number() OVER (PARTITION BY status ORDER BY {o}, book_id) AS INTEGER) AS place FROM book WHERE language = 'fr'" for m, o in _MODES.items()))
def library_sort(spark, d):
    """The list of each status in each of its orders."""
    from pyspark.sql import Window

    books = view(spark, d, "book").where("language = 'fr'")
    place = lambda m: F.row_number().over(Window.partitionBy("status").orderBy(*library.library_order(m)))
    pages = [books.select(F.lit(m).alias("mode"), "book_id", place(m).alias("place")) for m in _MODES]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


@query("facets", "book", "SELECT DISTINCT facet, value FROM (SELECT 'genre' AS facet, genre AS value FROM book UNION ALL SELECT 'author', author FROM book UNION ALL SELECT 'language', language FROM book) WHERE trim(coalesce(value, '')) <> ''")
def facets(spark, d):
    return library.facets(view(spark, d, "book"))


@query("settings_count", "character", "SELECT count(*) AS clones FROM character WHERE voice_id = 'clone-x'")
def settings_count(spark, d):
    return view(spark, d, "character").agg(F.count_if(F.col("voice_id") == "clone-x").alias("clones"))


@query("resume_set", "chapter segment", "SELECT chapter_id, book_id, position FROM chapter WHERE chapter_id NOT IN (SELECT chapter_id FROM segment)")
def resume_set(spark, d):
    return library.unanalysed(view(spark, d, "chapter"), view(spark, d, "segment")).select("chapter_id", "book_id", "position")


@query("generate_guard", "chapter segment", "SELECT book_id, array_to_string(list(position ORDER BY position), ',') AS missing FROM chapter WHERE chapter_id NOT IN (SELECT chapter_id FROM segment) GROUP BY book_id")
def generate_guard(spark, d):
    return library.missing_positions(view(spark, d, "chapter"), view(spark, d, "segment")).select("book_id", F.array_join("missing", ",").alias("missing"))


@query("progress", "queue_chapter", "SELECT book_id, count(*) AS chapters, count(*) FILTER (status = 'DONE') AS done, round(60 + count(*) FILTER (status = 'DONE') / count(*) * 30, 6) AS progress FROM queue_chapter GROUP BY book_id")
def progress(spark, d):
    return library.progress(view(spark, d, "queue_chapter"))


@query("playable", "queue_chapter", """, c AS (SELECT book_id, chapter_id, chapter_id AS position, status FROM queue_chapter)
SELECT book_id, chapter_id, position, lag(chapter_id) OVER w AS previous_id, lead(chapter_id) OVER w AS next_id FROM (SELECT * FROM c WHERE status = 'DONE') WINDOW w AS (PARTITION BY book_id ORDER BY position)""")
def playable_chapters(spark, d):
    return library.playable(view(spark, d, "queue_chapter").withColumn("position", F.col("chapter_id")))


@query("speech_stats", "segment", """, c AS (SELECT chapter_id % 7 AS book_id, chapter_id, count(*) FILTER (segment_type = 'DIALOGUE') AS d, count(*) FILTER (segment_type = 'DIALOGUE' AND character_id IS NOT NULL) AS a FROM segment GROUP BY ALL)
SELECT book_id, CAST(sum(d) AS BIGINT) AS dialogue, CAST(sum(a) AS BIGINT) AS attributed, round(avg(d), 6) AS mean, min(d) AS least, max(d) AS most FROM c GROUP BY book_id""")
def speech_stats(spark, d):
    return library.speech_stats(view(spark, d, "segment").withColumn("book_id", F.col("chapter_id") % 7))


# ---- timelines ---------------------------------------------------------------------------------------------------------

_OFFSETS = ", o AS (SELECT *, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM timeline)"


@query("timeline_offsets", "timeline", _OFFSETS + " SELECT chapter_id, position, duration_ms, offset_ms FROM o")
def timeline_offsets(spark, d):
    return timeline.offsets(view(spark, d, "timeline"))


@query("timeline_totals", "timeline", "SELECT chapter_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, count(*) AS segments FROM timeline GROUP BY chapter_id")
def timeline_totals(spark, d):
    return timeline.totals(view(spark, d, "timeline"))


@query("timeline_asof", "timeline probe", _OFFSETS + " SELECT p.event_id, p.chapter_id, p.ms, o.position FROM probe p ASOF LEFT JOIN o ON p.chapter_id = o.chapter_id AND p.ms >= o.offset_ms")
def timeline_asof(spark, d):
    return timeline.as_of(view(spark, d, "probe"), timeline.offsets(view(spark, d, "timeline")))


@query("reassemble_gate", "take", """, seg AS (SELECT DISTINCT segment_id, chapter_id FROM take), sel AS (SELECT DISTINCT segment_id FROM take WHERE is_selected AND audio_path IS NOT NULL)
SELECT chapter_id, bool_and(sel.segment_id IS NOT NULL) AS ready FROM seg LEFT JOIN sel USING (segment_id) GROUP BY chapter_id""")
def reassemble_gate(spark, d):
    takes = view(spark, d, "take")
    return timeline.ready_chapters(takes.select("segment_id", "chapter_id").distinct(), takes)


# ---- changes -----------------------------------------------------------------------------------------------------------

_MERGE = """, acc AS (SELECT * FROM suggestion WHERE status = 'PENDING'), gone AS (SELECT merged_id FROM acc)"""


@query("merge_accept", "suggestion character segment", _MERGE + """
SELECT 'segment' AS kind, s.segment_id AS id, CAST(coalesce(a.survivor_id, s.character_id) AS VARCHAR) AS value FROM segment s LEFT JOIN acc a ON a.merged_id = s.character_id
UNION ALL SELECT 'character', character_id, name FROM character WHERE character_id NOT IN (SELECT merged_id FROM gone)
UNION ALL SELECT 'suggestion', suggestion_id, CASE WHEN suggestion_id IN (SELECT suggestion_id FROM acc) THEN 'ACCEPTED' WHEN status = 'PENDING' AND (survivor_id IN (SELECT merged_id FROM gone) OR merged_id IN (SELECT merged_id FROM gone)) THEN 'REJECTED' ELSE status END FROM suggestion""")
def merge_accept(spark, d):
    suggestions = view(spark, d, "suggestion")
    s, c, g = mutate.accept_merges(view(spark, d, "segment"), view(spark, d, "character"), suggestions, suggestions)
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(value).cast("string").alias("value"))
    return row(s, "segment", "segment_id", "character_id").unionByName(row(c, "character", "character_id", "name")).unionByName(row(g, "suggestion", "suggestion_id", "status"))


@query("merge_accept_all", "suggestion", """, turn AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY suggestion_id) AS k FROM suggestion),
walk AS (
  SELECT DISTINCT book_id, 0::BIGINT AS k, NULL::BIGINT AS suggestion_id, NULL::VARCHAR AS status, []::BIGINT[] AS gone FROM suggestion
  UNION ALL
  SELECT w.book_id, t.k, t.suggestion_id, x.s, CASE WHEN t.status = 'PENDING' AND x.s = 'ACCEPTED' THEN list_append(w.gone, t.merged_id) ELSE w.gone END
  FROM walk w JOIN turn t ON t.book_id = w.book_id AND t.k = w.k + 1, LATERAL (SELECT CASE WHEN t.status <> 'PENDING' THEN t.status WHEN list_contains(w.gone, t.survivor_id) OR list_contains(w.gone, t.merged_id) THEN 'REJECTED' ELSE 'ACCEPTED' END AS s) x
) SELECT book_id, suggestion_id, status FROM walk WHERE k > 0""")
def merge_accept_all(spark, d):
    return mutate.accept_all(view(spark, d, "suggestion"))


@query("merge_names", "character", """, s AS (SELECT book_id, name AS survivor_name, CASE WHEN character_id % 3 = 0 THEN name WHEN character_id % 3 = 1 THEN 'nobody' ELSE first_value(name) OVER (PARTITION BY book_id ORDER BY name) END AS merged_name FROM character)
SELECT s.book_id, a.character_id AS survivor_id, b.character_id AS merged_id FROM s JOIN character a ON a.book_id = s.book_id AND a.name = s.survivor_name JOIN character b ON b.book_id = s.book_id AND b.name = s.merged_name WHERE survivor_name <> merged_name""")
def merge_names(spark, d):
    from pyspark.sql import Window

    characters = view(spark, d, "character")
    first = F.first("name").over(Window.partitionBy("book_id").orderBy("name"))
    n = F.col("character_id") % 3
    suggested = characters.select("book_id", F.col("name").alias("survivor_name"), F.when(n == 0, F.col("name")).when(n == 1, "nobody").otherwise(first).alias("merged_name"))
    return mutate.name_suggestions(suggested, characters)


@query("take_select", "take", """, pick AS (SELECT segment_id, min(take_id) AS chosen FROM take WHERE segment_id % 4 = 0 GROUP BY segment_id)
SELECT take_id, segment_id, CASE WHEN chosen IS NOT NULL THEN take_id = chosen ELSE is_selected END AS is_selected FROM take LEFT JOIN pick USING (segment_id)""")
def take_select(spark, d):
    takes = view(spark, d, "take")
    chosen = takes.where("segment_id % 4 = 0").groupBy("segment_id").agg(F.min("take_id").alias("take_id"))
    return mutate.select_takes(takes, chosen).select("take_id", "segment_id", "is_selected")


@query("voice_delete", "character", "SELECT character_id, CASE WHEN voice_id = 'clone-x' THEN NULL ELSE voice_id END AS voice_id FROM character")
def voice_delete(spark, d):
    return mutate.clear_voice(view(spark, d, "character"), "clone-x").select("character_id", "voice_id")


@query("book_cascade", "chapter segment character", """SELECT 'chapter' AS kind, chapter_id AS id FROM chapter WHERE book_id >= 3 UNION ALL SELECT 'segment', segment_id FROM segment WHERE chapter_id NOT IN (SELECT chapter_id FROM chapter WHERE book_id < 3)
UNION ALL SELECT 'character', character_id FROM character WHERE book_id >= 3""")
def book_cascade(spark, d):
    gone = spark.createDataFrame([(0,), (1,), (2,)], "book_id long")
    left = mutate.delete_books(gone, view(spark, d, "chapter"), view(spark, d, "segment"), view(spark, d, "character"))
    rows = [df.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")) for df, kind in zip(left, ("chapter", "segment", "character"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("reconcile", "book queue_chapter", """SELECT 'book' AS kind, book_id AS id, CASE WHEN status IN ('PROCESSING', 'GENERATING') THEN 'FAILED' ELSE status END AS status, CASE status WHEN 'PROCESSING' THEN 'analysis' WHEN 'GENERATING' THEN 'generation' END AS failed_stage FROM book
UNION ALL SELECT 'chapter', chapter_id, CASE WHEN status = 'GENERATING' THEN 'PENDING' ELSE status END, NULL FROM queue_chapter""")
def reconcile(spark, d):
    books = mutate.reconcile(view(spark, d, "book")).select(F.lit("book").alias("kind"), F.col("book_id").alias("id"), "status", "failed_stage")
    chapters = mutate.reconcile_chapters(view(spark, d, "queue_chapter"))
    return books.unionByName(chapters.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), "status", F.lit(None).cast("string").alias("failed_stage")))


@query("book_patch", "book", """SELECT book_id, CASE WHEN book_id % 3 = 0 THEN 'new ' || CAST(book_id AS VARCHAR) ELSE title END AS title, CASE WHEN book_id % 3 = 0 AND book_id % 2 = 0 THEN NULL ELSE genre END AS genre FROM book""")
def book_patch(spark, d):
    books = view(spark, d, "book").select("book_id", "title", "genre")
    changes = books.where("book_id % 3 = 0").select("book_id", F.concat(F.lit("new "), F.col("book_id").cast("string")).alias("title"), F.lit(True).alias("has_title"), F.lit(None).cast("string").alias("genre"), (F.col("book_id") % 2 == 0).alias("has_genre"))
    return mutate.patch(books, changes, "book_id", ["title", "genre"])


# ---- pages and audio ---------------------------------------------------------------------------------------------------


@query("page_text")
def page_text(spark, d):
    return pages_html.page_text(spark.read.parquet(f"{d}/pages.parquet"))


@query("wav_assembly", "segment", f"""SELECT chapter_id, CAST(sum({wav.RATE} * length(text) // 100) AS BIGINT) AS frames, CAST(trunc(CAST(sum({wav.RATE} * length(text) // 100) AS DOUBLE) / {wav.RATE} * 1000) AS INTEGER) AS ms FROM segment GROUP BY chapter_id""")
def wav_assembly(spark, d):
    made = wav.spoken(view(spark, d, "segment").select("segment_id", "chapter_id", "position", "text"), providers.silence)
    heads = made.where("at = 0")  # written last, when all samples of a chapter have been
    return heads.select("chapter_id", wav.header(F.col("content"))["frames"].alias("frames"), wav.duration_ms(F.col("content")).alias("ms"))


from storyloom.plans import audio, calls, changes, history, merges  # noqa: E402, F401  register their queries
