"""Queries over statuses, schema versions, signals and prompts with a known cast, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import signal
from storyloom.operators import segment, status
from storyloom.plans.queries import _STRIP, _WS, SPAN_SQL, query
from storyloom.plans.views import view
from storyloom.sources import versions
from storyloom.staging import new_path

_STATUS = "CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'ANALYZED' WHEN 'purchase' THEN 'GENERATING' ELSE CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'DONE' END END"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in (*status.MOVES, *status.AGAIN))


@query("status_moves", "", f"""WITH h AS (SELECT event_id, user_id AS book_id, {_STATUS} AS status, ts FROM events),
m AS (SELECT *, lag(status) OVER (PARTITION BY book_id ORDER BY ts, event_id) AS previous FROM h)
SELECT event_id, book_id, previous, status FROM m WHERE NOT (CASE WHEN previous IS NULL THEN status = '{status.FIRST}' ELSE previous = status OR (previous, status) IN ({_LEGAL}) END)""")
def status_moves(spark, d):
    history = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("book_id"), F.expr(_STATUS).alias("status"), F.col("ts").alias("at"))
    return status.illegal_moves(history, status.allowed_moves(spark)).select("event_id", "book_id", "previous", "status")


@query("schema_versions", "queue_chapter", """SELECT chapter_id, book_id, position, status,
CASE WHEN chapter_id % 4 < 2 THEN 0 WHEN chapter_id % 5 = 0 THEN NULL ELSE priority END AS priority,
chapter_id % 4 >= 2 AND queued AS cancel_requested, CASE WHEN chapter_id % 4 = 3 THEN TIMESTAMP '2020-01-01 00:00:00' + to_seconds(chapter_id) END AS queued_at FROM queue_chapter""")
def schema_versions(spark, d):
    """Chapters written under the baseline, untold and told, and two later versions."""
    path = new_path(spark, "chapter-versions")
    added = versions.ADDED["chapter"]
    now = view(spark, d, "queue_chapter").select(
        "chapter_id", "book_id", "position", "status", F.when(F.col("chapter_id") % 5 != 0, F.col("priority")).alias("priority"), F.col("queued").alias("cancel_requested"),
        (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("chapter_id"))).alias("queued_at"),
    )
    for n, version in enumerate((None, 0, 2, 3)):
        later = [a.column for a in added if a.version > (version or 0)]
        versions.write_version(now.where(F.col("chapter_id") % 4 == n).drop(*later), path, version)
    return versions.read_versions(spark, path, "chapter_id long, book_id long, position int, status string", added)


@query("resampled", "", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(least(greatest(x::DOUBLE, -1.0), 1.0) * 32767) AS BIGINT)) AS s FROM embeddings),
k AS (SELECT vec_id, s, unnest(range((len(s) - 1) * 147 // 160 + 1)) AS k FROM p)
SELECT vec_id, k, CAST(floor((s[k * 160 // 147 + 1] * (147 - (k * 160) % 147) + coalesce(s[k * 160 // 147 + 2], 0) * ((k * 160) % 147)) / 147.0) AS BIGINT) AS sample FROM k""")
def resampled(spark, d):
    clamp = F.transform("embedding", lambda x: (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("long"))
    pcm = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", clamp.alias("pcm"))
    out = pcm.select("vec_id", F.posexplode(signal.resample(F.col("pcm"), 24_000, 22_050)).alias("k", "sample"))
    return out.select("vec_id", F.col("k").cast("long").alias("k"), "sample")


@query("level_meter", "", f"""WITH f AS (SELECT vec_id, i, least(1.0, sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8) * {signal.GAIN}) AS target FROM embeddings, range(8) r(i)),
m AS (SELECT vec_id, list(target ORDER BY i) AS t FROM f GROUP BY vec_id),
walk(vec_id, i, level, t) AS (
  SELECT vec_id, 0, 0.0::DOUBLE, t FROM m
  UNION ALL SELECT vec_id, i + 1, level + (t[i + 1] - level) * CASE WHEN t[i + 1] > level THEN {signal.RISE} ELSE {signal.FALL} END, t FROM walk WHERE i < 8
) SELECT vec_id, CAST(i AS INTEGER) AS frame, CAST(round(level * 10000) AS BIGINT) AS level FROM walk WHERE i > 0""".replace("WITH f", "WITH RECURSIVE f"))
def level_meter(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    targets = rows.select("vec_id", F.transform(signal.frames(F.col("embedding"), 8), signal.loudness).alias("targets"))
    out = targets.select("vec_id", F.posexplode(signal.meter(F.col("targets"))).alias("i", "level"))
    return out.select("vec_id", (F.col("i") + 1).alias("frame"), F.round(F.col("level") * 10000).cast("long").alias("level"))


_CAST = "SELECT conv_id // 10 AS book_id, conv_id AS position, turn AS ord, role || ' ' || CAST((conv_id + turn) % 6 AS VARCHAR) AS name FROM conversations WHERE role IS NOT NULL"


@query("prompt_known", "dialogue_text", f""", {SPAN_SQL.strip()}, shown AS (SELECT chapter_id, index, is_dialogue, {_STRIP(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS t FROM span),
body AS (SELECT chapter_id, string_agg('[' || index || '][' || CASE WHEN is_dialogue THEN 'DIALOGUE' ELSE 'NARRATION' END || '] ' || t, chr(10) ORDER BY index) AS prompt FROM shown WHERE t <> '' GROUP BY chapter_id),
seen AS ({_CAST}), one AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY position, ord) AS r FROM seen),
known AS (SELECT b.chapter_id, string_agg(o.name, ', ' ORDER BY o.position, o.ord, o.name) AS names FROM body b JOIN one o ON o.r = 1 AND o.book_id = b.chapter_id // 10 AND o.position < b.chapter_id GROUP BY b.chapter_id)
SELECT b.chapter_id, coalesce('{segment.KNOWN}' || k.names || '.' || chr(10), '') || b.prompt AS prompt FROM body b LEFT JOIN known k USING (chapter_id)""")
def prompt_known(spark, d):
    chapters = view(spark, d, "dialogue_text").withColumn("book_id", F.expr("chapter_id div 10")).withColumn("position", F.col("chapter_id"))
    cast = spark.sql(_CAST.replace("//", "div").replace("VARCHAR", "STRING").replace("FROM conversations", "FROM {t}"), t=spark.read.parquet(f"{d}/conversations.parquet"))
    known = segment.known_names(cast, chapters)
    return segment.prompts(chapters.join(known, ["book_id", "position"]), known="known")
