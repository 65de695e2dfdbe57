"""Streams by chapter and by book, schema versions, moves of status, signals, known names, casting of large pools."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_sources import make

from storyloom.functions import signal
from storyloom.operators import cast, segment, status
from storyloom.sources import versions
from storyloom.streaming import ingest


def test_a_chapter_that_comes_again_replaces_its_own_segments(spark, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: ingest.segment_stream(ingest.chapter_stream(spark, given), out, str(tmp_path / "cp")).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, ingest.SCHEMA).coalesce(1).write.mode("append").parquet(given)
    every = spark.createDataFrame([(1, "fr", ""), (2, "en", ""), (3, "en", "")], ingest.SCHEMA)
    assert ingest.current_segments(spark, out).count() == 0 and ingest.left_to_segment(every, spark, out).count() == 3
    put([(1, "fr", 'Tôt. "Oui." Fin.'), (2, "en", '"Go."')])
    run()
    put([(1, "fr", "Autre.")])
    run()
    got = lambda: sorted((r.chapter_id, r.position, r.text) for r in ingest.current_segments(spark, out).collect())
    assert got() == [(1, 1, "Autre."), (2, 1, "Go.")]
    assert [r.chapter_id for r in ingest.left_to_segment(every, spark, out).collect()] == [3]
    spark.createDataFrame([(2, 1, 1, "half", "NARRATION")], "chapter_id long, position int, index int, text string, segment_type string").write.parquet(f"{out}/batch=9")  # without its log: unseen
    assert got() == [(1, 1, "Autre."), (2, 1, "Go.")]
    put([(1, "fr", "")])  # a chapter without segments is done, and its old ones are gone
    run()
    assert got() == [(2, 1, "Go.")]


def test_each_landing_book_is_parsed_once(spark, tmp_path):
    (tmp_path / "land").mkdir()
    run = lambda: ingest.landing_stream(ingest.book_stream(spark, str(tmp_path / "land")), str(tmp_path / "out"), str(tmp_path / "cp"), 20_000).awaitTermination()
    make(tmp_path / "one.epub")
    shutil.move(tmp_path / "one.epub", tmp_path / "land" / "one.epub")
    run()
    make(tmp_path / "two.epub")
    shutil.move(tmp_path / "two.epub", tmp_path / "land" / "two.epub")
    (tmp_path / "land" / "large.epub").write_bytes(b"x" * 30_000)
    (tmp_path / "land" / "notes.txt").write_text("no book")
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.title, r.position) for r in got if r.error is None) == [("one", 1), ("one", 2), ("two", 1), ("two", 2)]
    assert [r.path.rsplit("/")[-1] for r in got if r.error] == ["large.epub"]


def test_versions(spark, tmp_path):
    added, base, path = versions.ADDED["chapter"], "chapter_id long, status string", str(tmp_path / "t")
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    versions.write_version(rows([(1, "A")], base), path)
    versions.write_version(rows([(2, None)], base), path, 1)
    versions.write_version(rows([(3, "C", 7, True), (4, "D", None, None)], f"{base}, priority int, cancel_requested boolean"), path, 2)
    at = datetime.datetime(2026, 1, 2)
    versions.write_version(rows([(5, "E", 1, False, at)], f"{base}, priority int, cancel_requested boolean, queued_at timestamp_ntz"), path, 3)
    got = sorted(map(tuple, versions.read_versions(spark, path, base, added).collect()))
    assert got == [(1, "A", 0, False, None), (2, None, 0, False, None), (3, "C", 7, True, None), (4, "D", None, None, None), (5, "E", 1, False, at)]
    versions.write_version(rows([(6, "F")], base), path, 4)
    with pytest.raises(ValueError, match="later version: v=4"):
        versions.read_versions(spark, path, base, added)
    assert versions.schema_state(["chapter_id", "status"], base, added) == (1, ["cancel_requested", "priority", "queued_at"])
    assert versions.schema_state(["chapter_id", "status", "priority", "cancel_requested"], base, added) == (2, ["queued_at"])
    assert versions.schema_state(["status"], base, added)[0] is None


def test_moves_of_status(spark):
    history = [(1, 1, "PENDING"), (1, 2, "PROCESSING"), (1, 3, None), (1, 4, "ANALYZED"), (1, 5, "ANALYZED"), (1, 6, "DONE"), (2, 1, "DONE"), (3, 1, "PENDING"), (3, 2, "PENDING"), (3, 3, "FAILED")]
    df = spark.createDataFrame([(b, at, at, s) for b, at, s in history], "book_id long, at long, event_id long, status string")
    got = sorted((r.book_id, r.at, r.previous, r.status) for r in status.illegal_moves(df, status.allowed_moves(spark)).collect())
    assert got == [(1, 3, "PROCESSING", None), (1, 6, "ANALYZED", "DONE"), (2, 1, None, "DONE"), (3, 3, "PENDING", "FAILED")]


@pytest.mark.parametrize("source,target", [(24_000, 22_050), (22_050, 44_100), (3, 7), (5, 5), (44_100, 8_000)])
def test_resampling_against_a_plain_loop(spark, source, target):
    rng = random.Random(source)
    given = [[rng.randint(-32768, 32767) for _ in range(n)] for n in (0, 1, 2, 97)] + [None]

    def brute(x):
        out, k = [], 0
        while x and k * source <= (len(x) - 1) * target:
            i, rest = divmod(k * source, target)
            out.append(x[i] if not rest else (x[i] * (target - rest) + x[i + 1] * rest) // target)
            k += 1
        return out

    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x array<int>")
    assert {r.i: r.y for r in df.select("i", signal.resample(F.col("x"), source, target).alias("y")).collect()} == {i: None if x is None else brute(x) for i, x in enumerate(given)}


def test_meter(spark):
    df = spark.createDataFrame([([0.5, 0.5, -0.5, 0.5, 0.0],), ([],)], "x array<float>").select(signal.meter(F.transform(signal.frames(F.col("x"), 2), signal.loudness)).alias("m"))
    high, rest = df.collect()
    assert high.m == pytest.approx([0.45, 0.45 + 0.55 * 0.45, (0.45 + 0.55 * 0.45) * 0.88]) and rest.m == []


def test_known_names_grow_by_chapter(spark):
    seen = spark.createDataFrame([(1, 1, 2, "B"), (1, 1, 1, "A"), (1, 2, 1, "A"), (1, 3, 1, "C"), (2, 1, 1, "Z")], "book_id long, position int, ord int, name string")
    chapters = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (3, 1)], "book_id long, position int")
    got = {(r.book_id, r.position): r.known for r in segment.known_names(seen, chapters).collect()}
    assert got == {(1, 1): [], (1, 2): ["A", "B"], (1, 3): ["A", "B"], (1, 4): ["A", "B", "C"], (3, 1): []}


def test_casting_against_a_fold(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        own = rng.choice([None] * 6 + ["narrator", "male_0", "c1", "female_0"])
        rows.append((rng.randint(0, 3), i, rng.choice(["n%02d" % rng.randint(0, 60), None]), rng.choice(["MALE", "FEMALE", "NEUTRAL", "UNKNOWN"]), rng.choice(["ADULT", "ELDER", "UNKNOWN"]), rng.choice(["warm", "cold", None]), rng.choice(["deep", None]), own))
    df = spark.createDataFrame(rows, "book_id long, character_id long, name string, gender string, age_category string, tone string, voice_quality string, voice_id string")
    clones = spark.createDataFrame([("c2", "MALE", 2), ("c1", "MALE", 1), ("c3", None, 3)], "voice_id string, gender string, ord long")
    ranked = {r.character_id: r.candidates for r in cast.ranked_voices(df).collect()}
    want = {}
    for book in range(4):
        mine = sorted((r for r in rows if r[0] == book), key=lambda r: (r[2] is None, r[2] or "", r[1]))
        used = {r[7] for r in mine if r[7] and r[7] != "narrator"}
        for r in mine:
            voice = r[7]
            if voice is None:
                wanted = [*(["c1", "c2"] if r[3] == "MALE" else []), *ranked[r[1]]]
                voice = next((v for v in wanted if v not in used), ranked[r[1]][0])
                used.add(voice)
            want[r[1]] = voice
    assert {r.character_id: r.voice_id for r in cast.assign_voices(df, clones).collect()} == want
