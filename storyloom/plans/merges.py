"""Queries over whole chains of merges, deletions, stops and resumption, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import mutate
from storyloom.plans.queries import query
from storyloom.plans.views import view

# The fold of a book in order: which suggestions are accepted, and after it where each merged character ends.
_WALK = """, turn AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY suggestion_id) AS k FROM chain),
walk AS (
  SELECT DISTINCT book_id, 0::BIGINT AS k, NULL::BIGINT AS suggestion_id, NULL::VARCHAR AS status, []::BIGINT[] AS gone FROM chain
  UNION ALL
  SELECT w.book_id, t.k, t.suggestion_id, x.s, CASE WHEN t.status = 'PENDING' AND x.s = 'ACCEPTED' THEN list_append(w.gone, t.merged_id) ELSE w.gone END
  FROM walk w JOIN turn t ON t.book_id = w.book_id AND t.k = w.k + 1, LATERAL (SELECT CASE WHEN t.status <> 'PENDING' THEN t.status WHEN list_contains(w.gone, t.survivor_id) OR list_contains(w.gone, t.merged_id) THEN 'REJECTED' ELSE 'ACCEPTED' END AS s) x
),
told AS (SELECT book_id, suggestion_id, status FROM walk WHERE k > 0),
edge AS (SELECT c.merged_id, c.survivor_id FROM chain c JOIN told t USING (suggestion_id) WHERE c.status = 'PENDING' AND t.status = 'ACCEPTED'),
hop AS (SELECT merged_id, survivor_id AS ends FROM edge UNION ALL SELECT h.merged_id, e.survivor_id FROM hop h JOIN edge e ON e.merged_id = h.ends),
last AS (SELECT merged_id, ends FROM hop WHERE ends NOT IN (SELECT merged_id FROM edge))
"""


def _row(df: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(value).cast("string").alias("value"))


@query("merge_chains", "chain character segment", _WALK + """
SELECT 'segment' AS kind, s.segment_id AS id, CAST(coalesce(l.ends, s.character_id) AS VARCHAR) AS value FROM segment s LEFT JOIN last l ON l.merged_id = s.character_id
UNION ALL SELECT 'character', character_id, name FROM character WHERE character_id NOT IN (SELECT merged_id FROM edge)
UNION ALL SELECT 'suggestion', suggestion_id, status FROM told""")
def merge_chains(spark, d):
    s, c, g = mutate.accept_all_merges(view(spark, d, "segment"), view(spark, d, "character"), view(spark, d, "chain"))
    return _row(s, "segment", "segment_id", "character_id").unionByName(_row(c, "character", "character_id", "name")).unionByName(_row(g, "suggestion", "suggestion_id", "status"))


_GONE = "book_id % 4 = 1"


@query("book_delete_all", "book queue_chapter take character suggestion", f"""
SELECT 'book' AS kind, book_id AS id FROM book WHERE NOT ({_GONE})
UNION ALL SELECT 'chapter', chapter_id FROM queue_chapter WHERE NOT ({_GONE})
UNION ALL SELECT 'segment', segment_id FROM (SELECT DISTINCT segment_id, chapter_id FROM take) WHERE chapter_id NOT IN (SELECT chapter_id FROM queue_chapter WHERE {_GONE})
UNION ALL SELECT 'take', take_id FROM take WHERE chapter_id NOT IN (SELECT chapter_id FROM queue_chapter WHERE {_GONE})
UNION ALL SELECT 'character', character_id FROM character WHERE NOT ({_GONE})
UNION ALL SELECT 'suggestion', suggestion_id FROM suggestion WHERE NOT ({_GONE})""")
def book_delete_all(spark, d):
    take = view(spark, d, "take")
    tables = {"books": view(spark, d, "book"), "chapters": view(spark, d, "queue_chapter"), "segments": take.select("segment_id", "chapter_id").distinct(), "takes": take, "characters": view(spark, d, "character"), "suggestions": view(spark, d, "suggestion")}
    left = mutate.delete_everything(tables["books"].where(_GONE), tables)
    out = None
    for name, table in left.items():
        rows = table.select(F.lit(name[:-1]).alias("kind"), F.col(f"{name[:-1]}_id").cast("long").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("chapter_stop", "queue_chapter", """SELECT chapter_id, status, status = 'GENERATING' AND chapter_id % 3 = 0 AS cancel_requested, CASE WHEN status <> 'GENERATING' AND chapter_id % 3 = 0 THEN 'not being generated: ' || status END AS error FROM queue_chapter""")
def chapter_stop(spark, d):
    chapters = view(spark, d, "queue_chapter").withColumn("cancel_requested", F.lit(False))
    return mutate.stop_chapters(chapters, chapters.where("chapter_id % 3 = 0")).select("chapter_id", "status", "cancel_requested", "error")


@query("analysis_plan", "book queue_chapter", """, has AS (SELECT book_id, count(*) AS n, count(*) FILTER (status = 'DONE') AS done FROM queue_chapter GROUP BY book_id),
p AS (SELECT b.book_id, b.status = 'FAILED' AND b.book_id % 12 <> 5 AND coalesce(h.n, 0) > 0 AS resume, coalesce(h.n, 0) AS n, coalesce(h.done, 0) AS done FROM book b LEFT JOIN has h USING (book_id))
SELECT book_id, resume, CASE WHEN resume THEN done ELSE 0 END AS done, n - CASE WHEN resume THEN done ELSE 0 END AS left FROM p""")
def analysis_plan(spark, d):
    chapters = view(spark, d, "queue_chapter")
    return mutate.analysis_plan(view(spark, d, "book"), chapters, chapters.where("status = 'DONE'"), F.col("book_id") % 12 == 5)
