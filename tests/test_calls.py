"""Calls of a language model's contract: what is asked, and what is made of odd replies."""

import json

import pandas as pd

from storyloom.operators import labels, synthesis
from storyloom.sources import providers

CAST = "book_id long, character_id long, name string, gender string, age_category string, description string"


def test_merges_are_asked_for_books_of_two_and_more(spark, tmp_path):
    cast = spark.createDataFrame([(1, 1, "Ode", "FEMALE", "ADULT", None), (2, 2, "Tarn", "MALE", "ADULT", ""), (2, 3, "Old Tarn", "MALE", "ELDER", "bent"), (2, 4, "Ode", None, None, None)], CAST)

    def asked(batches):
        for batch in batches:
            for book, prompt in zip(batch["book_id"], batch["prompt"], strict=True):
                assert book == 2 and prompt.count("\n") == 3, "a book with one character is not asked about"
            names = [{"survivor_name": a, "merged_name": b} for a, b in (("Tarn", "Old Tarn"), ("Tarn", "Nobody"), ("Ode", "Ode"), (None, "Ode"))]
            yield pd.DataFrame({"book_id": batch["book_id"], "raw": json.dumps({"merges": [7, *names]})})

    assert [tuple(r) for r in synthesis.suggested_merges(cast, asked).collect()] == [(2, 2, "Tarn", "Old Tarn", None)]
    assert [tuple(r) for r in synthesis.suggested_merges(cast, providers.same_trait).collect()] == [(2, 1, "Tarn", "Old Tarn", "MALE")]
    assert synthesis.suggested_merges(cast.where("false"), providers.same_trait).count() == 0


def test_replies_to_odd_prompts(spark):
    prompts = spark.createDataFrame([(1, "[1][NARRATION] a\n[2][DIALOGUE] b\n[4][DIALOGUE] c\n[5][DIALOGUE] [6][DIALOGUE] d"), (2, None), (3, "")], "chunk_id long, prompt string")
    replies = providers.analyse(prompts, providers.in_turn)
    assert replies.count() == 3 and labels.errors(replies).count() == 0
    assert sorted((r.chunk_id, r["index"], r.character_name) for r in labels.attributions(replies).collect()) == [(1, 2, "One"), (1, 4, "Other"), (1, 5, "One")]
    assert [r.name for r in labels.declared(replies).orderBy("ord").collect()] == ["One", "Other"]
