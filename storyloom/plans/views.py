"""Adapter views: the tables of a data directory as books, chapters, segments, characters, takes and replies.

Each view is written twice, as a Spark DataFrame and as SQL for DuckDB, so that queries can be held against an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = {
    "chapter": """
      SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS book_id, doc_id AS chapter_id, CAST(doc_id AS INTEGER) AS position, text AS raw_text, lang AS language
      FROM documents WHERE text IS NOT NULL""",
    "dialogue_turn": """
      SELECT conv_id AS chapter_id, turn, CASE
        WHEN turn % 3 = 2 THEN '— ' || replace(text, chr(10), ' ') || ', dit Orlan.'
        WHEN role = 'user' THEN '"' || replace(replace(text, chr(10), ' '), '"', '') || '"'
        ELSE replace(text, chr(10), ' ') END AS t
      FROM conversations WHERE text IS NOT NULL""",
    "dialogue_text": """
      SELECT chapter_id, CASE WHEN chapter_id % 3 = 0 THEN 'en' WHEN chapter_id % 3 = 1 THEN 'fr-FR' END AS language,
             string_agg(t, chr(10) || chr(10) ORDER BY turn) AS raw_text
      FROM dialogue_turn GROUP BY chapter_id""",
    "segment": """
      SELECT conv_id * 1000 + turn AS segment_id, conv_id AS chapter_id, CAST(turn + 1 AS INTEGER) AS position,
             CASE WHEN role = 'assistant' THEN 'DIALOGUE' ELSE 'NARRATION' END AS segment_type,
             CASE WHEN role = 'assistant' AND turn % 5 <> 4 THEN conv_id % 40 + 1 END AS character_id, text
      FROM conversations""",
    "character": """
      SELECT CAST(c_nationkey AS BIGINT) AS book_id, c_custkey AS character_id, c_name AS name,
             CASE c_custkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'NEUTRAL' ELSE 'UNKNOWN' END AS gender,
             CASE c_custkey % 5 WHEN 0 THEN 'CHILD' WHEN 1 THEN 'YOUNG_ADULT' WHEN 2 THEN 'ADULT' WHEN 3 THEN 'ELDER' ELSE 'UNKNOWN' END AS age_category,
             CASE c_custkey % 6 WHEN 0 THEN 'Warm' WHEN 1 THEN 'gentle' WHEN 2 THEN 'cold' WHEN 3 THEN 'neutral' WHEN 4 THEN '' END AS tone,
             CASE c_custkey % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'Smooth' END AS voice_quality,
             CASE WHEN c_custkey % 7 = 0 THEN 'male_0' WHEN c_custkey % 11 = 0 THEN 'narrator' WHEN c_custkey % 13 = 0 THEN 'clone-x' END AS voice_id
      FROM customer""",
    "book": """
      SELECT c_custkey AS book_id, c_name AS title, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 8 = 0 THEN NULL ELSE c_mktsegment END AS author,
             CASE c_custkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN 'ANALYZED' WHEN 3 THEN 'GENERATING' WHEN 4 THEN 'DONE' ELSE 'FAILED' END AS status,
             CASE c_custkey % 4 WHEN 0 THEN 'qwen' WHEN 1 THEN 'edgetts' WHEN 2 THEN 'piper' END AS tts_provider,
             CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'genre ' || CAST(c_nationkey % 6 AS VARCHAR) END AS genre,
             CASE c_custkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' END AS language,
             CASE WHEN c_custkey % 4 <> 0 THEN 1900 + c_custkey % 120 END AS published_at, c_custkey * 7919 % 100003 AS created_at
      FROM customer""",
    "queue_chapter": """
      SELECT o_orderkey AS chapter_id, o_custkey AS book_id, CAST(o_orderkey % 1000 AS INTEGER) AS position,
             CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'PENDING' ELSE 'GENERATING' END AS status,
             6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderkey % 3 <> 0 AS queued
      FROM orders""",
    "timeline": """
      SELECT l_orderkey AS chapter_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS position,
             CAST(l_quantity AS BIGINT) * 100 AS duration_ms
      FROM lineitem""",
    "probe": "SELECT event_id, user_id AS chapter_id, CAST(floor(value * 100) AS BIGINT) AS ms FROM events",
    "take": """
      SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS take_id, l_orderkey * 10 + l_linenumber AS segment_id, l_orderkey AS chapter_id,
             CASE WHEN l_partkey % 17 <> 0 THEN 'take-' || CAST(l_partkey AS VARCHAR) END AS audio_path, l_suppkey % 2 = 0 AS is_selected
      FROM lineitem""",
    "suggestion": """
      SELECT book_id, character_id AS suggestion_id, character_id AS survivor_id, character_id + 25 AS merged_id,
             CASE WHEN character_id % 10 = 9 THEN 'REJECTED' ELSE 'PENDING' END AS status
      FROM character WHERE character_id % 2 = 0""",
    "chain": """
      SELECT c_custkey % 25 AS book_id, c_custkey AS suggestion_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 25 ELSE c_custkey END AS survivor_id,
             CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 25 END AS merged_id, CASE WHEN c_custkey % 11 = 9 THEN 'REJECTED' ELSE 'PENDING' END AS status
      FROM customer""",
    "reply": """
      SELECT conv_id AS chunk_id, CASE
        WHEN conv_id % 11 = 3 THEN '[1, 2]' WHEN conv_id % 11 = 5 THEN 'no json' WHEN conv_id % 11 = 7 THEN NULL
        ELSE '{"characters": [{"name": "Orlan Tarn", "gender": "m, ", "age_category": "Old"}, "junk", {"gender": "F"}, {"name": "Mara", "tone": "warm"}], "attributions": ['
          || '{"index": 1, "character_name": "Orlan", "emotion": "calm"}, {"index": "2", "character_name": "Mara"}, {"index": "x", "character_name": "Mara"}, 7, '
          || '{"index": 3, "character_name": "Professor Mara"}, {"index": 4, "character_name": "une voix basse", "emotion": "glad"}, {"index": ' || CAST(max(turn) + 5 AS VARCHAR) || ', "character_name": "Odile"}]}' END AS raw
      FROM conversations GROUP BY conv_id""",
}

#: Views that a view reads.
NEEDS = {"dialogue_text": ["dialogue_turn"], "suggestion": ["character"]}


def with_views(names: str, query: str) -> str:
    """A DuckDB statement: the named views before the query."""
    ordered: list[str] = []
    for name in names.split():
        ordered += [n for n in [*NEEDS.get(name, []), name] if n not in ordered]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n].strip()})" for n in ordered) + "\n" + query


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark side of a view."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "dialogue_text":
        turns = view(spark, sf_dir, "dialogue_turn")
        texts = turns.groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"]), "\n\n").alias("raw_text"))
        language = F.when(F.col("chapter_id") % 3 == 0, "en").when(F.col("chapter_id") % 3 == 1, "fr-FR")
        return texts.select("chapter_id", language.alias("language"), "raw_text")
    if name == "timeline":
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return table("lineitem").select(F.col("l_orderkey").alias("chapter_id"), F.row_number().over(order).alias("position"), (F.col("l_quantity").cast("long") * 100).alias("duration_ms"))
    if name == "suggestion":
        return spark.sql(SQL[name].replace("FROM character", "FROM {t}").replace("VARCHAR", "STRING"), t=view(spark, sf_dir, "character"))
    base = {"chapter": "documents", "dialogue_turn": "conversations", "segment": "conversations", "character": "customer", "book": "customer", "chain": "customer", "queue_chapter": "orders", "probe": "events", "take": "lineitem", "reply": "conversations"}[name]
    text = SQL[name].replace("{", "{{").replace("}", "}}").replace(f"FROM {base}", "FROM {t}").replace("VARCHAR", "STRING")
    return spark.sql(text, t=table(base))
