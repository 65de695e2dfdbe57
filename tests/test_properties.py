"""Invariants on random input: spans and chunks lose nothing, offsets are sums, one take is selected."""

import random

from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import mutate, segment, timeline

PIECES = ["«", "»", "“", "”", '"', "— ", "–", "\n", "\n\n", " ", "\r", " ", "dit Mara", ", dit-il.", "Oui ?", "mot", ".", ",", "é", "'", "’", "\t", " "]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_spans_join_to_the_text(spark):
    texts = random_texts(600, 1)
    df = spark.createDataFrame([(i, "fr" if i % 2 else "en", t) for i, t in enumerate(texts)], "chapter_id long, language string, raw_text string")
    found = {}
    for r in segment.spans(df).orderBy("chapter_id", "index").collect():
        found.setdefault(r.chapter_id, []).append(r)
    for i, t in enumerate(texts):
        assert "".join(r.text for r in found[i]) == t
        assert [r["index"] for r in found[i]] == list(range(1, len(found[i]) + 1))
    assert any(r.incise_character == "Mara" for rows in found.values() for r in rows)


def packed(text, budget):
    """The packing rule, told plainly."""

    def split(t, sep):
        out, now, size = [], [], 0
        for part in [p for p in t.split(sep) if p.strip()]:
            n = len(part) // 4
            if n > budget:
                out += [sep.join(now)] if now else []
                now, size = [], 0
                out += split(part, "\n") if sep == "\n\n" else [part]
            elif size + n > budget and now:
                out.append(sep.join(now))
                now, size = [part], n
            else:
                now.append(part)
                size += n
        return (out + ([sep.join(now)] if now else [])) or [t]

    return [text] if len(text) // 4 <= budget else split(text, "\n\n")


def test_chunks_follow_the_rule(spark):
    texts = [t.replace("\r", "").replace(" ", "") for t in random_texts(400, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "chapter_id long, raw_text string")
    for budget in (3, 8):
        found = {}
        for r in segment.chunks(df, budget).orderBy("chapter_id", "chunk").collect():
            found.setdefault(r.chapter_id, []).append(r.text)
        assert [found[i] for i in range(len(texts))] == [packed(t, budget) for t in texts]


def test_white_space_is_pythons(spark):
    texts = random_texts(300, 3)
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.collapse(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [" ".join(t.split()) for t in texts]


def test_offsets_are_running_sums(spark):
    rng = random.Random(4)
    rows = [(c, p, rng.choice([0, 1, 100, 999])) for c in range(30) for p in range(1, rng.randint(2, 20))]
    total = dict.fromkeys(range(30), 0)
    for r in timeline.offsets(spark.createDataFrame(rows, "chapter_id long, position int, duration_ms long")).orderBy("chapter_id", "position").collect():
        assert r.offset_ms == total[r.chapter_id]
        total[r.chapter_id] += r.duration_ms


def test_one_take_is_selected(spark):
    rng = random.Random(5)
    takes = [(t, rng.randrange(40), rng.random() < 0.5) for t in range(200)]
    picked = {s: t for t, s, _ in takes}
    after = mutate.select_takes(spark.createDataFrame(takes, "take_id long, segment_id long, is_selected boolean"), spark.createDataFrame([(t, s) for s, t in picked.items()], "take_id long, segment_id long"))
    chosen = [(r.segment_id, r.take_id) for r in after.where("is_selected").collect()]
    assert sorted(chosen) == sorted(picked.items())
