"""The sink with a commit, the ledger of finished chapters, joins and slices of WAV files."""

import io
import os
import wave

import pytest
from pyspark.sql import functions as F

from storyloom.operators import generation
from storyloom.sources import audio_files, providers, wav


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if not n.endswith(".crc"))


def sound(body, rate=1000, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(body)
    return out.getvalue()


def test_files_come_back_and_later_writes_win(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    assert audio_files.read_files(spark, root).count() == 0
    first = spark.createDataFrame([(f"x/{i}.wav", bytes([i]) * i) for i in range(1, 20)], "name string, content binary").repartition(3)
    audio_files.write_files(first, root)
    audio_files.write_files(spark.createDataFrame([("x/3.wav", b"later")], "name string, content binary"), root)
    got = {r.name: bytes(r.content) for r in audio_files.read_files(spark, root).collect()}
    assert got == {f"x/{i}.wav": b"later" if i == 3 else bytes([i]) * i for i in range(1, 20)}


def test_pieces_are_joined_in_order(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    rows = [(f"{n}.bin", at, bytes([at % 251])) for n in range(3) for at in range(40)]
    audio_files.write_files(spark.createDataFrame(rows, "name string, at long, content binary").repartition(5), root)
    assert {r.name: bytes(r.content) for r in audio_files.read_files(spark, root).collect()} == {f"{n}.bin": bytes(range(40)) for n in range(3)}


@pytest.mark.parametrize("bad", [[("ok.wav", b"1"), ("../out.wav", b"2")], [("ok.wav", b"1"), (None, b"2")], [("ok.wav", b"1"), ("/etc/x", b"2")], [("ok.wav", b"1"), ("empty.wav", b"")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    root = f"file://{tmp_path}/a"
    with pytest.raises(Exception, match="not a file name|empty file"):
        audio_files.write_files(spark.createDataFrame(bad, "name string, content binary").repartition(2), root)
    assert listed(f"{tmp_path}/a") == [] and audio_files.read_files(spark, root).count() == 0


def test_what_a_lost_driver_leaves_is_unseen(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    audio_files.write_files(spark.createDataFrame([("a.wav", b"1")], "name string, content binary"), root)
    os.makedirs(f"{tmp_path}/a/data/{'0' * 32}/0-0")
    with open(f"{tmp_path}/a/data/{'0' * 32}/0-0/b.wav", "wb") as out:
        out.write(b"2")
    with open(f"{tmp_path}/a/log/_aside", "w") as out:
        out.write('{"job": "' + "0" * 32 + '", "folder": "' + "0" * 32 + '/0-0"}')
    assert [r.name for r in audio_files.read_files(spark, root).collect()] == ["a.wav"]


def generated(spark, tmp_path, run, silent=(), stopped=()):
    rows = [(c, 10 * c + p, p, "narrator", f"Chapter {c} line {p}" + "!" * p) for c in range(1, 5) for p in range(3)]
    segments = spark.createDataFrame(rows, "chapter_id long, segment_id long, position int, voice_id string, text string")
    lines = segments.select("segment_id", F.when(~F.col("segment_id").isin(*silent, -1), F.col("text")).alias("text"))
    stops = spark.createDataFrame([(c,) for c in stopped], "chapter_id long")
    audio = providers.synthesise(lines, providers.echo)
    out = generation.write_chapters(spark, f"file://{tmp_path}", run, segments, audio, stops)
    return segments, {r.chapter_id: (r.status, r.voiced) for r in out.collect()}


def test_abandoned_chapters_are_unseen_and_resumed(spark, tmp_path):
    root = f"file://{tmp_path}"
    segments, told = generated(spark, tmp_path, "one", silent=[20], stopped=[3])
    assert told == {1: ("DONE", 3), 2: ("PENDING", 2), 3: ("PENDING", 3), 4: ("DONE", 3)}
    assert {r.chapter_id for r in generation.chapter_files(spark, root, "one").collect()} == {1, 3, 4}  # written before the wish to stop was read
    assert {r.chapter_id for r in generation.finished_chapters(spark, root, "one").collect()} == {1, 4}
    assert {r.segment_id for r in generation.finished_takes(spark, root, "one", segments).collect()} == {10, 11, 12, 40, 41, 42}
    assert {r.chapter_id for r in generation.remaining(segments, spark, root).collect()} == {2, 3}
    whole = {r.chapter_id: bytes(r.content) for r in generation.finished_chapters(spark, root, "one").collect()}
    for r in generation.finished_takes(spark, root, "one", segments).collect():
        text = f"Chapter {r.segment_id // 10} line {r.segment_id % 10}" + "!" * (r.segment_id % 10)
        body = text.encode() + b" " * (len(text) % 2)
        assert bytes(r.content) == wav.wrap_pcm(body, 1000) and body in whole[r.segment_id // 10]
    _, told = generated(spark, tmp_path, "two")
    assert {s for s, _ in told.values()} == {"DONE"}
    assert generation.finished_chapters(spark, root, "one").count() == 0 and generation.finished_chapters(spark, root, "two").count() == 4
    assert generation.remaining(segments, spark, root).count() == 0


def test_join_from_files_equals_join_in_rows(spark, tmp_path):
    chapters = [(b, p, sound(bytes([b, p]) * (50 * p + 1))) for b in (1, 2) for p in range(4)]
    odd = [(3, 0, sound(b"ab" * 5)), (3, 1, sound(b"ab" * 5, rate=2000)), (4, 0, sound(b"ab")), (4, 1, b"no sound"), (5, 0, sound(b""))]
    files = spark.createDataFrame(chapters + odd, "book_id long, position int, content binary").repartition(3)
    for piece in (7, 1 << 20):
        pieces, errors = wav.joined(files, "book_id", "position", piece=piece)
        root = f"file://{tmp_path}/{piece}"
        audio_files.write_files(pieces.select(F.format_string("%d.wav", "book_id").alias("name"), "at", "content"), root)
        got = {r.name: bytes(r.content) for r in audio_files.read_files(spark, root).collect()}
        want = wav.assemble(files.where("book_id in (1, 2, 5)"), "book_id", "position", "content").collect()
        assert got == {f"{r.book_id}.wav": bytes(r.audio) for r in want}
        assert {r.book_id: r.error for r in errors.collect()} == {3: "another format at 1", 4: "not a WAV at 1"}


def test_slices(spark):
    body = bytes(range(200))
    given = [(i, sound(body, 1000, channels, width)) for i, (channels, width) in enumerate([(1, 2), (2, 2), (1, 1)])]
    df = spark.createDataFrame(given, "i int, content binary").crossJoin(spark.createDataFrame([(0, 5), (3, 4), (90, 50), (300, 1), (-1, 2), (3, -2)], "a int, n int"))
    for r in df.withColumn("cut", wav.slice_audio(F.col("content"), F.col("a"), F.col("n"))).collect():
        with wave.open(io.BytesIO(bytes(r.content))) as src:
            size, frames = src.getnchannels() * src.getsampwidth(), src.getnframes()
            if not 0 <= r.a <= frames:
                assert r.cut is None
                continue
            want = sound(body[r.a * size : (r.a + max(r.n, 0)) * size], 1000, src.getnchannels(), src.getsampwidth())
        assert bytes(r.cut) == want


def test_many_chunks_before_the_samples(spark):
    plain = wav.wrap_pcm(b"abcd", 1000)
    extra = b"".join(b"LIST" + (1).to_bytes(4, "little") + b"x\x00" for _ in range(200))
    odd = plain[:36] + extra + plain[36:]
    row = spark.createDataFrame([(odd,), (plain[:36] + extra,), (b"RIFF",), (b"",), (None,)], "content binary").select(wav.header(F.col("content"))["frames"].alias("n"), wav.samples(F.col("content")).alias("s")).collect()
    assert [r.n for r in row] == [2, None, None, None, None] and bytes(row[0].s) == b"abcd"


def test_chapters_are_spoken_in_pieces(spark):
    lines = [(1, 12, 3, "ab"), (1, 11, 2, None), (1, 10, 1, "xyz" * 9), (2, 20, 1, None), (3, 30, 1, ""), (None, None, 1, "null"), (None, None, 2, "key"), (4, 40, 1, "q"), (4, 40, 2, "q")]
    df = spark.createDataFrame(lines, "chapter_id long, segment_id long, position int, text string").repartition(3)
    for piece in (5, 1 << 20):
        made: dict = {}
        for r in wav.spoken(df, providers.echo, piece=piece).collect():
            assert r.error is None and (r.content is None or len(r.content) <= max(piece, 44))
            made.setdefault(r.chapter_id, []).append((r.at, bytes(r.content) if r.content is not None else None))
        got = {k: b"".join(c for _, c in sorted(v)) if v[0][1] is not None else None for k, v in made.items()}
        want = {1: b"xyz" * 9 + b" ab", 3: b"", None: b"nullkey ", 4: b"q q "}
        assert got == {k: wav.wrap_pcm(b, 1000) for k, b in want.items()} | {2: None}
    mixed = lambda batches: (b.assign(audio=[wav.wrap_pcm(b"ab", 1000 + len(t)) if t != "bad" else b"bad" for t in b["text"]]) for b in batches)
    odd = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "bb"), (2, 3, 1, "bad"), (3, 4, 1, "c")], df.schema)
    told = {r.chapter_id: (r.error, r.content is None) for r in wav.spoken(odd, mixed).where("at = 0").collect()}
    assert "format" in told[1][0] and "not a WAV" in told[2][0] and told[3] == (None, False)


def test_wav_assembly_beyond_an_arrow_batch(spark, tmp_path):
    """Lines of one task whose audio is over 2 GB together; null texts and chapters of nothing else."""
    from oracle import duck_rows, spark_rows

    from storyloom.plans.queries import ORACLE_SQL, QUERIES

    rows = spark.range(5600).selectExpr("id div 8 as conv_id", "id % 8 as turn", "'user' as role", "case when id % 19 = 0 or id div 8 = 3 then null else repeat('é', 1000) end as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import pyarrow.parquet as pq

    table = pq.read_table(f"{tmp_path}/conversations.parquet")
    assert spark_rows(QUERIES["wav_assembly"](spark, str(tmp_path))) == duck_rows(None, ORACLE_SQL["wav_assembly"], conversations=table)


def test_takes_of_many_frames_are_whole(spark, tmp_path):
    """1001 frames at 1000 a second are 1.001 s, which as milliseconds of a double is cut to 1000."""
    texts = {10: "a" * 2002, 11: "é" * 1003, 12: "", 13: "end"}
    segments = spark.createDataFrame([(1, k, k, "narrator") for k in texts], "chapter_id long, segment_id long, position int, voice_id string")
    audio = providers.synthesise(spark.createDataFrame(list(texts.items()), "segment_id long, text string"), providers.echo)
    generation.write_chapters(spark, f"file://{tmp_path}", "run", segments, audio, spark.createDataFrame([], "chapter_id long"))
    got = {r.segment_id: bytes(r.content) for r in generation.finished_takes(spark, f"file://{tmp_path}", "run", segments).collect()}
    assert got == {k: wav.wrap_pcm(t.encode() + b" " * (len(t.encode()) % 2), 1000) for k, t in texts.items()}


def test_takes_keep_the_format_and_end_with_the_samples(spark):
    chapters = spark.createDataFrame([(1, sound(bytes(range(120)), 500, 2, 2)), (2, sound(bytes(range(50)), 500, 1, 1))], "chapter_id long, audio binary")
    spans = [(1, 10, "v", 0, 10), (1, 11, "v", 10, 90), (1, 12, None, 31, 1), (2, 20, "v", 3, 4), (2, 21, "v", 50, 4), (2, 22, "v", -1, 4)]
    got = {r.segment_id: r.audio and bytes(r.audio) for r in generation.take_rows(chapters, spark.createDataFrame(spans, "chapter_id long, segment_id long, voice_id string, first_frame long, frames long")).collect()}
    two, one = bytes(range(120)), bytes(range(50))
    assert got == {10: sound(two[:40], 500, 2), 11: sound(two[40:], 500, 2), 12: None, 20: sound(one[3:7], 500, 1, 1), 21: sound(b"", 500, 1, 1), 22: None}


def test_reading_lists_no_folder_of_files(spark, tmp_path):
    """Readers go by the lists that tasks have written; a file that shrank is an error, not a shorter sound."""
    root = f"file://{tmp_path}/a"
    audio_files.write_files(spark.createDataFrame([("x/1.wav", b"one"), ("y/2.wav", b"two")], "name string, content binary").coalesce(1), root)
    (folder,) = [n for n in listed(f"{tmp_path}/a") if n.endswith("1.wav")]
    with open(f"{tmp_path}/a/{folder}".replace("1.wav", "9.wav"), "wb") as out:
        out.write(b"unlisted")
    assert {(r.name, r.length, bytes(r.content)) for r in audio_files.read_files(spark, root).collect()} == {("x/1.wav", 3, b"one"), ("y/2.wav", 3, b"two")}
    assert [r.name for r in audio_files.read_files(spark, root, "y/").collect()] == ["y/2.wav"]
    with open(f"{tmp_path}/a/{folder}", "wb") as out:
        out.write(b"o")
    with pytest.raises(Exception, match="1 bytes where 3 were written"):
        audio_files.read_files(spark, root).collect()
