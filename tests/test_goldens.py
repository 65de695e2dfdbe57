"""Golden rows: segmentation, speech tags, profiles, chunks, labels, names, casting, changes, pages, audio."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import cast, labels, library, mutate, segment, timeline
from storyloom.sources import html, providers, wav


def chapters(spark, *rows):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)], "chapter_id long, language string, raw_text string")


def kinds(spark, *rows):
    found = segment.spans(chapters(spark, *rows)).orderBy("chapter_id", "index").collect()
    out = {}
    for r in found:
        out.setdefault(r.chapter_id, []).append(r)
    for i, (_, text) in enumerate(rows):
        assert "".join(r.text for r in out[i]) == text
        assert [r["index"] for r in out[i]] == list(range(1, len(out[i]) + 1))
    return ["".join("D" if r.is_dialogue else "N" for r in out[i]) for i in range(len(rows))]


def test_segmentation(spark):
    cases = [
        ("fr", 'Mara waited. "Ready," she said.', "NDN"), ("fr", "Il entra. « Bonsoir », dit-il.", "NDN"), ("fr", "Elle hésita.\n— Tu pars déjà ?", "ND"), ("fr", "La pluie tombait.", "N"),
        ("fr", 'Tôt. « Oui ! » Tard. "Non." Fin.', "NDNDN"), ("en", "— Are they here?", "N"), ("en", 'He sat. "Go!" she cried. "Now."', "NDND"), ("fr", "a “x” b “open", "NDN"), ("fr", "", "N"),
        (None, "x\r— y — z", "N"),
    ]
    assert kinds(spark, *[c[:2] for c in cases]) == [c[2] for c in cases]


def test_a_text_may_hold_the_mark_of_borders(spark):
    texts = ["a\u0001b", "\u0001", "«\u0001» x\n— Non,\u0001 dit Mara.\n“y” \u0001“z”", "\u0001« a »« b »"]
    with_mark, without = (segment.spans(chapters(spark, *[(lang, t) for lang in ("fr", "en") for t in of])).orderBy("chapter_id", "index").collect() for of in (texts, [t.replace("\u0001", "#") for t in texts]))
    assert [(r.chapter_id, r.text.replace("\u0001", "#"), r.is_dialogue, r.incise_character) for r in with_mark] == [(r.chapter_id, r.text, r.is_dialogue, r.incise_character) for r in without]
    assert len(with_mark) > 16


@pytest.mark.parametrize(
    ("line", "head", "tail", "name"),
    [
        ("— Je n'y crois pas, dit-elle doucement.", "— Je n'y crois pas,", " dit-elle doucement.", None), ("— Tu restes ? demanda-t-il.", "— Tu restes ?", " demanda-t-il.", None),
        ("— Bonsoir, dit Mara.", "— Bonsoir,", " dit Mara.", "Mara"), ("— Quel calme !", "— Quel calme !", None, None), ("— Non, répondit-il, mais je viens.", "— Non, répondit-il, mais je viens.", None, None),
        ("— Bravo, s’exclama Mr Tarn.", "— Bravo,", " s’exclama Mr Tarn.", "Mr Tarn"), ("— Halte ! s’écria-t-il.", "— Halte !", " s’écria-t-il.", None),
    ],
)
def test_speech_tags(spark, line, head, tail, name):
    rows = segment.spans(chapters(spark, ("fr", line))).orderBy("index").collect()
    assert [r.text for r in rows] == [x for x in (head, tail) if x is not None]
    assert rows[0].is_dialogue and rows[0].incise_character == name


def test_stripped_text(spark):
    rows = segment.segments(chapters(spark, ("fr", "— Je n'y crois pas, dit-elle doucement.\n« Oui » “Non” \"Si\""))).orderBy("position").collect()
    assert [r.text for r in rows] == ["Je n'y crois pas", "dit-elle doucement.", "Oui", "Non", "Si"]


def test_profiles(spark):
    en = ["en", "en-US", "en-GB", "eng", "English", "ENGLISH", "  en  ", "anglais"]
    fr = [None, "", "fr", "fr-FR", "fre", "français", "de", "es", "??"]
    got = spark.createDataFrame([(x,) for x in en + fr], "x string").select(X.language_profile(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == ["en"] * len(en) + ["fr"] * len(fr)


def chunk(spark, text, budget):
    return [r.text for r in segment.chunks(chapters(spark, ("fr", text)), budget).orderBy("chunk").collect()]


def test_chunks(spark):
    assert chunk(spark, "short\n\ntext", 100) == ["short\n\ntext"]
    paragraphs = [c * 100 for c in "abc"]
    assert chunk(spark, "\n\n".join(paragraphs), 30) == paragraphs
    lines = "\n".join(c * 40 for c in "abcdef")
    assert chunk(spark, "intro\n\n" + lines + "\n\nend", 25) == ["intro", "\n".join(["a" * 40, "b" * 40]), "\n".join(["c" * 40, "d" * 40]), "\n".join(["e" * 40, "f" * 40]), "end"]
    assert chunk(spark, "x" * 500 + "\n\nend", 25) == ["x" * 500, "end"]
    assert chunk(spark, " \n\n " * 100, 5) == [" \n\n " * 100]
    assert chunk(spark, "a" * 40 + "\n\n" + "b" * 40, 20) == ["a" * 40 + "\n\n" + "b" * 40]


def reply(characters=(), attributions=()):
    return json.dumps({"characters": list(characters), "attributions": list(attributions)})


def folded(spark, *raws):
    df = spark.createDataFrame(list(enumerate(raws)), "chunk_id long, raw string")
    rows = labels.folded_labels(df).orderBy("chunk_id", "index").collect()
    return df, [(r.chunk_id, r["index"], r.character_name, r.emotion, r.registered) for r in rows]


def test_label_replies(spark):
    raws = [
        reply([{"name": "Mara"}], [{"index": 2, "character_name": "Mara", "emotion": "calm"}]),
        reply([{"name": "Mara"}], ["x", {"index": "2", "character_name": "Mara"}, {"index": "no", "character_name": "Mara"}]),
        reply(["x", {"gender": "F"}, {"name": "Mara", "gender": "odd"}], [{"index": 1, "character_name": "une voix basse"}]),
        reply([{"name": "Corin Halvard"}], [{"index": 1, "character_name": "Corin"}]),
        reply([{"name": "Marsal"}], [{"index": 1, "character_name": "Docteur Marsal"}]),
        reply([{"name": "Mara"}], [{"index": 1, "character_name": "Tobias"}, {"index": 2, "character_name": "Tobias"}]),
        reply([{"name": "Mara"}], [{"index": 1, "character_name": "Mara"}, {"index": 1, "character_name": "chacun", "emotion": "glad"}]),
    ]
    df, got = folded(spark, *raws)
    assert got == [
        (0, 2, "Mara", "calm", False), (1, 2, "Mara", None, False), (3, 1, "Corin Halvard", None, False), (4, 1, "Marsal", None, False),
        (5, 1, "Tobias", None, True), (5, 2, "Tobias", None, True), (6, 1, "Mara", "glad", False),
    ]
    assert [(r.name, r.gender) for r in labels.declared(df).where("chunk_id = 2").collect()] == [("Mara", "UNKNOWN")]


def test_replies_that_fail_as_a_whole(spark):
    bad = ["{", None, "[1]", '{"characters": null}', reply([{"name": "A", "gender": None}]), reply([], [{"index": 1, "character_name": 7}])]
    df = spark.createDataFrame(list(enumerate(bad)), "chunk_id long, raw string")
    assert labels.errors(df).count() == len(bad)
    assert labels.folded_labels(df).count() == 0


def test_a_named_speaker_in_the_text_wins_if_known(spark):
    spans = segment.spans(chapters(spark, ("fr", "— Bonsoir, dit Mara."), ("fr", "— Bonsoir, dit Mara."))).withColumnRenamed("chapter_id", "chunk_id")
    raws = [reply([{"name": "Mara"}, {"name": "Odile"}], [{"index": 1, "character_name": "Odile"}]), reply([{"name": "Odile"}], [{"index": 1, "character_name": "Odile"}])]
    df = spark.createDataFrame(list(enumerate(raws)), "chunk_id long, raw string")
    rows = labels.script(spans, labels.folded_labels(df), labels.declared(df)).orderBy("chunk_id", "position").collect()
    assert [(r.chunk_id, r.text, r.character_name) for r in rows] == [(0, "Bonsoir", "Mara"), (0, "dit Mara.", None), (1, "Bonsoir", "Odile"), (1, "dit Mara.", None)]


def test_enums(spark):
    cases = [("DIALOG, ", "DIALOGUE"), ("Dialogue", "DIALOGUE"), ("prose", "NARRATION"), ("Monologue!", "DIALOGUE"), ("???", "NARRATION"), (" narration - long", "NARRATION")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "x string").select(X.coerce_enum(F.col("x"), "segment_type", "NARRATION").alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in cases]


def people(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "book_id long, character_id long, name string, gender string, age_category string, tone string, voice_quality string, voice_id string")


def voices(df, clones=None):
    return [r.voice_id for r in cast.assign_voices(df, clones).orderBy("name").collect()]


def test_casting(spark):
    scored = {r.candidate: r.score for r in cast.voice_scores(people(spark, ("a", "MALE", "ADULT", "warm", "deep", None))).collect()}
    assert scored["male_0"] == 8 and scored["narrator"] < 0
    three = people(spark, ("a", "MALE", "YOUNG_ADULT", None, None, None), ("b", "MALE", "ADULT", None, None, None), ("c", "MALE", "ELDER", None, None, None))
    assert voices(three) == ["male_1", "male_0", "male_2"]
    four = people(spark, *[(n, "MALE", "UNKNOWN", None, None, None) for n in "abcd"])
    assert voices(four) == ["male_0", "male_1", "male_2", "male_0"]
    assert voices(people(spark, ("a", "MALE", "UNKNOWN", None, None, "male_0"), ("b", "MALE", "ADULT", "warm", "deep", None)))[0] == "male_0"
    clones = spark.createDataFrame([("clone", "MALE", 1)], "voice_id string, gender string, ord long")
    assert voices(people(spark, ("a", "MALE", "UNKNOWN", None, None, None), ("b", "MALE", "UNKNOWN", None, None, None)), clones) == ["clone", "male_0"]
    assert voices(people(spark, ("a", "UNKNOWN", "UNKNOWN", None, None, None))) == ["neutral_0"]


def test_library_orders(spark):
    books = spark.createDataFrame([(1, "b", "X", 1950, 5), (2, "A", None, None, 9), (3, "c", "y", 1900, 7)], "book_id long, title string, author string, published_at int, created_at long")
    order = lambda mode: [r.book_id for r in books.orderBy(*library.library_order(mode)).collect()]
    assert [order(m) for m in ("recent", "title", "author", "published_desc", "published_asc")] == [[2, 3, 1], [2, 1, 3], [2, 1, 3], [1, 3, 2], [3, 1, 2]]


def test_transcript_and_offsets(spark):
    segments = spark.createDataFrame([(1, 1, 1, "NARRATION", None), (2, 1, 2, "DIALOGUE", 7), (3, 1, 3, "DIALOGUE", 8), (4, 1, 4, "DIALOGUE", None)], "segment_id long, chapter_id long, position int, segment_type string, character_id long")
    cast_ = spark.createDataFrame([(7, "A", "male_0"), (8, "B", None)], "character_id long, name string, voice_id string")
    assert [r.voice_id for r in library.transcript(segments, cast_).orderBy("position").collect()] == ["narrator", "male_0", "narrator", "narrator"]
    line = spark.createDataFrame([(1, 1, 1200), (1, 2, 800), (1, 3, 0), (1, 4, 5)], "chapter_id long, position int, duration_ms long")
    timed = timeline.offsets(line)
    assert [r.offset_ms for r in timed.orderBy("position").collect()] == [0, 1200, 2000, 2000]
    probes = spark.createDataFrame([(1, 1, -1), (2, 1, 0), (3, 1, 1999), (4, 1, 2000), (5, 9, 3)], "event_id long, chapter_id long, ms long")
    assert [r.position for r in timeline.as_of(probes, timed).orderBy("event_id").collect()] == [None, 1, 2, 4, None]


def test_merges_and_takes(spark):
    segments = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "segment_id long, character_id long")
    characters = spark.createDataFrame([(4, "A"), (5, "B"), (6, "C")], "character_id long, name string")
    suggestions = spark.createDataFrame([(1, 1, 4, 5, "PENDING"), (1, 2, 5, 6, "PENDING"), (1, 3, 5, 4, "REJECTED")], "book_id long, suggestion_id long, survivor_id long, merged_id long, status string")
    s, c, g = mutate.accept_merges(segments, characters, suggestions, suggestions.where("suggestion_id = 1"))
    assert [r.character_id for r in s.orderBy("segment_id").collect()] == [4, 6, None]
    assert sorted(r.character_id for r in c.collect()) == [4, 6]
    assert [r.status for r in g.orderBy("suggestion_id").collect()] == ["ACCEPTED", "REJECTED", "REJECTED"]
    assert [r.status for r in mutate.accept_all(suggestions).orderBy("suggestion_id").collect()] == ["ACCEPTED", "REJECTED", "REJECTED"]
    takes = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True)], "take_id long, segment_id long, is_selected boolean")
    picked = mutate.select_takes(takes, spark.createDataFrame([(2, 1)], "take_id long, segment_id long"))
    assert [r.is_selected for r in picked.orderBy("take_id").collect()] == [False, True, True]


def test_pages():
    assert html.extract("<h1>T</h1><p>a\n  b</p>") == ("T\na b", "T")
    assert html.extract("<div><p>a</p><p>b</p></div>") == ("a\nb", None)
    assert html.extract("<title>x</title><div>lost<p>a<br>b</p></div><script>s</script><!-- c -->") == ("ab", "x")
    assert html.extract("<title>x</title><h2> </h2>just text")[1] is None
    assert html.extract("one <b>two</b>") == ("one\ntwo", None)
    assert html.extract(None) == ("", None)


class Tree(HTMLParser):
    """Every text goes to all open elements, one by one."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks = [], []

    def handle_starttag(self, tag, attrs):
        if tag != "br":
            self.open.append({"tag": tag, "text": "", "inner": False})
        if tag in html.BLOCKS:
            for above in self.open[:-1]:
                above["inner"] = True
            self.blocks.append(self.open[-1])

    def handle_endtag(self, tag):
        at = [i for i, e in enumerate(self.open) if e["tag"] == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        for e in self.open:
            e["text"] += data


def test_pages_against_a_tree():
    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice(["<p>", "<div>", "</p>", "</div>", "<b>", "</b>", "<h2>", "</h2>", "<li>", "</ul>", "<br>", "one ", "two ", "\n"]) for _ in range(rng.randint(1, 25)))
        tree = Tree()
        tree.feed("<div>" + page)
        tree.close()
        lines = [" ".join(b["text"].split()) for b in tree.blocks if not b["inner"]]
        assert html.extract("<div>" + page)[0] == "\n".join(x for x in lines if x), page
    assert html.extract("<p>x</b>" * 50_000)[0] == "x"  # none is ever closed, so the last alone holds no other


def test_audio(spark):
    lines = spark.createDataFrame([(2, 1, 2, "bb"), (1, 1, 1, "a")], "segment_id long, chapter_id long, position int, text string")
    audio = providers.synthesise(lines.select("segment_id", "text"), providers.silence)
    row = wav.assemble(lines.join(audio, "segment_id")).withColumn("h", wav.header(F.col("audio"))).first()
    assert (row.frames, row.error, row.h.channels, row.h.width, row.h.rate, row.h.frames) == (220 + 441, None, 1, 2, wav.RATE, 661)
    mixed = spark.createDataFrame([(1, 1, bytearray(wav.wrap_pcm(b"\0\0"))), (1, 2, bytearray(wav.wrap_pcm(b"\0\0", 8000)))], "chapter_id long, position int, audio binary")
    assert "format" in wav.assemble(mixed).first().error
    assert wav.slice_wav(wav.wrap_pcm(bytes(range(200)) * 2, 1000), 10, 5) == wav.wrap_pcm((bytes(range(200)) * 2)[20:30], 1000)
    calls = []
    with pytest.raises(ValueError):
        providers.with_retries(lambda t: calls.append(t) or int(t))("x")
    assert len(calls) == 3


def test_small_functions(spark):
    row = spark.range(1).select(
        X.minutes_seconds(F.lit(125.9)).alias("t"), X.seek(F.lit(5.0), F.lit(-9.0), F.lit(None).cast("double")).alias("s"), X.flag(F.lit("fr-ca")).alias("f"), X.flag(F.lit("fr")).alias("n"),
        X.humanize(F.lit("male_0")).alias("h"), X.slug(F.lit("Élan Vif!")).alias("g"), X.pcm16(F.array(F.lit(2.0), F.lit(-0.5))).alias("p"), X.first_set(F.lit(""), F.lit("b")).alias("c"),
    ).first()
    assert tuple(row) == ("2:05", 0.0, "🇨🇦", None, "Male 0", "lan-vif", [32767, -16383], "b")
