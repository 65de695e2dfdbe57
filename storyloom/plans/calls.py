"""Queries that call a language model's contract with a deterministic stand-in: prompt, reply, and the rows read from the reply."""

from __future__ import annotations

from storyloom.operators import labels, segment, synthesis
from storyloom.plans.queries import _STRIP, _WS, SPAN_SQL, query
from storyloom.plans.views import view
from storyloom.sources import providers

_SHOWN = f"""{SPAN_SQL.strip()}, shown AS (SELECT chapter_id, index, is_dialogue, {_STRIP(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS t FROM span)"""


@query("analysis_call", "dialogue_text", f""", {_SHOWN},
line AS (SELECT chapter_id, index, row_number() OVER (PARTITION BY chapter_id ORDER BY index) AS n FROM shown WHERE is_dialogue AND t <> '')
SELECT chapter_id, CAST(n AS INTEGER) AS ord, CAST(index AS BIGINT) AS index, CASE n % 2 WHEN 1 THEN 'One' ELSE 'Other' END AS character_name FROM line""")
def analysis_call(spark, d):
    prompts = segment.prompts(view(spark, d, "dialogue_text"))
    replies = providers.analyse(prompts, providers.in_turn, key="chapter_id")
    return labels.attributions(replies, key="chapter_id").select("chapter_id", "ord", "index", "character_name")


@query("merge_suggest", "character", """, told AS (SELECT *, first_value(name) OVER (PARTITION BY book_id, gender ORDER BY character_id) AS survivor FROM character)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY character_id) AS INTEGER) AS ord, survivor AS survivor_name, name AS merged_name, gender AS reason FROM told WHERE name <> survivor""")
def merge_suggest(spark, d):
    cast = view(spark, d, "character").withColumnRenamed("tone", "description")
    return synthesis.suggested_merges(cast, providers.same_trait)
