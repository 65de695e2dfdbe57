"""Accepting merges: chains, conflicts and repeats against a fold in plain Python."""

import random

import pytest

from storyloom.operators import mutate

SUGGESTION = "book_id long, suggestion_id long, survivor_id long, merged_id long, status string"


def fold(rows):
    """(status by suggestion, where each merged character ends)."""
    gone, status = {}, {}
    for book, i, survivor, merged, now in sorted(rows, key=lambda r: r[1]):
        if now == "PENDING":
            now = "REJECTED" if (book, survivor) in gone or (book, merged) in gone else "ACCEPTED"
            if now == "ACCEPTED":
                gone[book, merged] = survivor
        status[i] = now

    def end(book, c):
        while (book, c) in gone:
            c = gone[book, c]
        return c

    return status, {c: end(book, c) for book, c in gone}


@pytest.mark.parametrize("seed", [1, 2])
def test_accept_all_against_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        book = rng.randint(0, 3)
        a, b = rng.sample(range(book * 100, book * 100 + 20), 2)
        rows.append((book, i, a, b, rng.choice(["PENDING"] * 5 + ["REJECTED", "ACCEPTED"])))
    rows += [(9, 200 + i, 900 + i + 1, 900 + i, "PENDING") for i in range(12)]  # one long chain
    rows += [(8, 300 + i, 800 + i, 800 + i + 1, "PENDING") for i in range(8)]  # every other one loses
    status, ends = fold(rows)
    segments = spark.createDataFrame([(c * 10 + k, c) for c in range(1000) for k in range(2)] + [(-1, None)], "segment_id long, character_id long")
    characters = spark.createDataFrame([(c // 100, c, f"n{c}") for c in range(1000)], "book_id long, character_id long, name string")
    s, c, g = mutate.accept_all_merges(segments, characters, spark.createDataFrame(rows, SUGGESTION).repartition(3))
    assert {r.suggestion_id: r.status for r in g.collect()} == status
    assert {r.segment_id: r.character_id for r in s.collect()} == {-1: None} | {x * 10 + k: ends.get(x, x) for x in range(1000) for k in range(2)}
    assert {r.character_id for r in c.collect()} == set(range(1000)) - set(ends)


def test_accept_merges_never_multiplies_rows(spark):
    rows = [(0, 1, 1, 2, "PENDING"), (0, 2, 3, 2, "PENDING"), (0, 3, 2, 4, "PENDING"), (0, 4, 5, 6, "PENDING"), (0, 5, 7, 5, "PENDING")]
    suggestions = spark.createDataFrame(rows, SUGGESTION)
    segments = spark.createDataFrame([(i, i) for i in range(1, 8)], "segment_id long, character_id long")
    characters = spark.createDataFrame([(0, i, "n") for i in range(1, 8)], "book_id long, character_id long, name string")
    s, c, g = mutate.accept_merges(segments, characters, suggestions, suggestions)
    assert {r.suggestion_id: r.status for r in g.collect()} == {1: "ACCEPTED", 2: "REJECTED", 3: "REJECTED", 4: "ACCEPTED", 5: "PENDING"}
    assert sorted((r.segment_id, r.character_id) for r in s.collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert {r.character_id for r in c.collect()} == {1, 3, 4, 5, 7}


def test_repeated_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(1, "x", True), (1, "x", True)], "k long, v string, has_v boolean")
    assert sorted(map(tuple, mutate.patch(table, changes, "k", ["v"]).collect())) == [(1, "x"), (2, "b")]
    takes = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True)], "take_id long, segment_id long, is_selected boolean")
    got = mutate.select_takes(takes, takes.where("segment_id = 1"))
    assert sorted((r.take_id, r.is_selected) for r in got.collect()) == [(1, False), (2, True), (3, True)]


def test_replacing_suggestions_and_forced_reset(spark):
    old = spark.createDataFrame([(1, 1, 1, 2, "PENDING"), (1, 2, 1, 3, "ACCEPTED"), (2, 3, 4, 5, "PENDING")], SUGGESTION)
    new = spark.createDataFrame([(1, 9, 1, 4, "PENDING")], SUGGESTION)
    left = mutate.replace_suggestions(old, new, spark.createDataFrame([(1,)], "book_id long"))
    assert {r.suggestion_id for r in left.collect()} == {2, 3, 9}
    from pyspark.sql import functions as F

    chapters = spark.createDataFrame([(1, "DONE"), (2, "DONE"), (3, "GENERATING")], "chapter_id long, status string")
    got = mutate.force_reset(chapters, F.col("chapter_id") != 2).collect()
    assert {r.chapter_id: r.status for r in got} == {1: "PENDING", 2: "DONE", 3: "GENERATING"}
