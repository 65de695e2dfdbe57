"""Decontamination and URL rules."""

import random

import cases
from oracle import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from storyloom.llm import decontamination as dc
from storyloom.llm import urls

ITEM = "When Tom walked 12 km to see Ann, he paid 3 dollars and then gave Ann another 12 coins before walking home."


def found(spark, texts, items, **options):
    docs = cases.awkward(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in dc.leaks(docs, bench, **options).collect()}


TEXTS = {
    1: "Some words first. " + ITEM + " And words after.",
    2: "Intro here now. " + ITEM.replace("Tom", "Bob").replace("Ann", "Eve").replace("12", "40").replace("3 ", "9.5 ") + " The end.",
    3: "Intro here now. " + ITEM.replace("12 coins", "77 coins") + " The end.",
    4: cases.words(300, 8),
    5: None,
    6: "",
    7: ITEM.upper(),
    8: "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
}


def test_leaks(spark):
    items = [ITEM, None, "", "one two", "five short words right here", "1 2 3 4 5 6 7 8 9 10"]
    texts = {**TEXTS, 9: "we saw five short words right here today"}
    want = {(1, 0): "verbatim", (2, 0): "reparameterised", (9, 4): "verbatim"}
    got = found(spark, texts, items)
    got.pop((7, 0), None)  # capitals hide which words are names
    assert got == want
    assert {k: v for k, v in found(spark, texts, items, broadcast_windows=0).items() if k[0] != 7} == want
    assert found(spark, texts, []) == {} and found(spark, {}, items) == {}


LONG = cases.words(40, 31).split()
SHORT = cases.words(15, 32).split()


def test_edited_and_partly_quoted_items(spark):
    items = [" ".join(LONG), " ".join(SHORT)]
    around = lambda *w: " ".join([cases.words(30, 33), *w, cases.words(30, 34)])
    texts = {
        1: around(*LONG[:20], "inserted", *LONG[20:]), 2: around(*LONG[:20], *LONG[21:]), 3: around(*LONG[:13], "xx", *LONG[14:26], "yy", *LONG[27:]), 4: around(*LONG[10:30]),
        5: around(*SHORT[:7], "xx", *SHORT[8:]), 6: around(*SHORT[:7], "two", "words", *SHORT[7:]), 7: around(*LONG[:8]), 8: around(*LONG[:9], *cases.words(60, 35).split(), *LONG[15:24]), 9: around(*SHORT[:6]),
    }
    assert found(spark, texts, items) == {(d, 0): "verbatim" for d in (1, 2, 3, 4)} | {(d, 1): "verbatim" for d in (5, 6)}


FRIENDS = "Natalia sold 5 clips to her friends in April. Natalia then sold 7 clips fewer in May. How many clips did she sell?"


def test_reparameterised_openings_and_equal_fillings(spark):
    other = FRIENDS.replace("Natalia", "Weng")
    texts = {
        1: "First. " + other, 2: "First. " + FRIENDS.replace("5", "6").replace("7", "6"), 3: "First. " + other.replace("5", "9").replace("7", "9"),
        4: "Here Weng" + other[4:], 5: FRIENDS.upper(), 6: FRIENDS.lower(),
    }
    got = found(spark, texts, [FRIENDS])
    assert got == {(d, 0): "reparameterised" for d in (1, 2, 3, 4)} | {(5, 0): "verbatim", (6, 0): "verbatim"}
    # Different fillings of one number or name remain no leak where one run has them.
    ann = "Later Ann paid 5 coins and then after lunch Ann got 5 coins back again."
    assert found(spark, {1: ann.replace("5 coins back", "6 coins back"), 2: ann.replace("Ann got", "Eve got")}, [ann]) == {}


def test_items_in_other_surroundings_and_short_items(spark):
    items = ["What is the capital city of France?", "Which planet is largest?", "What is 12 + 30 - 7 * 2?", "Say yes.", "7 8 9 10"]
    texts = {
        1: "Q: What is the capital city of France? A: Paris", 2: "Question: Which planet is largest?", 3: "trivia night (what is the CAPITAL city of france) now", 4: "So: What is the capital city of Spain?",
        5: "Solve. What is 12 + 30 - 7 * 2? Thanks", 6: "Solve. What is 13 + 31 - 8 * 4? Thanks", 7: "SAY YES", 8: "Please say yes to it", 9: "say no", 10: "7 8 9 10 11", 11: "What is the one? Which planet is it?",
    }
    want = {(1, 0): "verbatim", (2, 1): "verbatim", (3, 0): "verbatim", (4, 0): "reparameterised", (5, 2): "verbatim", (7, 3): "verbatim"}
    assert found(spark, texts, items) == want
    assert found(spark, texts, items, broadcast_windows=0, broadcast_hashes=0) == want


def test_repeated_keys_are_one_document(spark):
    half, rest = " ".join(LONG[:18]), " ".join(LONG[12:])
    docs = spark.createDataFrame([(1, half), (1, half), (1, half), (2, rest), (2, rest), (None, rest)], "doc_id long, text string")
    got = dc.leaks(docs, spark.createDataFrame([(0, " ".join(LONG))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in got} == {(1, 0): 13, (2, 0): 23}


def test_items_of_numbers_and_of_scripts_without_blanks(spark):
    count = "Add 1 2 3 4 5 6 7 then 8 9 10 11 12 13 14 then 15 16 17 18 19 20 21 then 22 23 24 25 26 27"
    items = [count, "Compute 12 + 30 - 7 * 2 + 9 - 4 + 51 * 3 - 8 + 6 * 77 - 15", "日本の首都はどこですか", "3 4 5 6 7 8 9 10"]
    texts = {
        1: f"Warm up. {count} Well done.", 2: f"See below. {items[1]} = 99 or so", 3: "昨日聞かれました。日本の首都はどこですか。東京です。", 4: "昨日聞かれました。東京は日本にあります。", 5: "Rows 3 4 5 6 7 8 9 10 are empty",
        6: "See below. " + items[1].replace("30", "31").replace("51", "52").replace("77", "78"),
    }
    want = {(1, 0): "verbatim", (2, 1): "verbatim", (3, 2): "verbatim"}
    assert found(spark, texts, items) == want  # an item without any word matches nothing
    assert found(spark, texts, items, broadcast_windows=0) == want


def test_a_long_document_full_of_passages_takes_little_memory(spark):
    passage = cases.words(30, 41)
    items = [f"{passage} {cases.words(6, 42 + i)}" for i in range(4)]
    texts = {1: " ".join([passage] * 667), 2: cases.words(20_000, 8)}  # with its text beside each window that is met: over 40 GB
    assert found(spark, texts, items) == {(1, i): "verbatim" for i in range(4)}


def brute_leaks(docs, items):
    """Every pair of windows of every diagonal, one by one; tokens are lists of marked words."""
    slot = lambda t, kinds: t[0] if t[0] in kinds else t.lstrip("\2\6")
    shapes = {"slots": lambda t: "\2" if t[0] == "\6" else slot(t, "\1\2\3"), "words": lambda t: slot(t, "\1\3"), "values": lambda t: slot(t, "")}
    least = {"slots": lambda n: n >= 3, "words": lambda n: n >= 2, "values": lambda n: n < 2}
    out = {}
    for d, doc in docs.items():
        for k, item in items.items():
            n = len(item)
            plan = {"slots": 4 if n < 6 else 6, "words": 4 if n < 24 else 6, "values": 4}
            if not any(shapes["values"](t)[0] > "\5" for t in item):
                del plan["values"]
            told, hits = set(), {}
            for shape, w in plan.items():
                f = shapes[shape]
                for i in range(n - w + 1):
                    mine = [f(t) for t in item[i : i + w]]
                    if least[shape](sum(x[0] > "\5" for x in mine)):
                        told |= set(range(i, i + w))
                        for p in range(len(doc) - w + 1):
                            if mine == [f(t) for t in doc[p : p + w]]:
                                hits.setdefault(p - i, set()).add((i, w))
            runs = []
            for shift, at in sorted(hits.items()):
                open_ = []
                for i, w in sorted(at):
                    if open_ and i <= open_[-1][1]:
                        open_[-1] = (open_[-1][0], max(open_[-1][1], i + w))
                    else:
                        open_.append((i, i + w))
                for lo, hi in open_:
                    inside = [(i, w) for i, w in at if lo <= i < hi]
                    pairs = {(item[q], doc[q + shift]) for i, w in inside for q in range(i, i + w) if item[q][0] in "\1\2\3\6"}
                    bare = lambda t: t.lstrip("\2\6")
                    pairs = {(a[0], bare(a), bare(b)) for a, b in pairs if a[0] != "\6" or bare(a) != bare(b)}
                    names = {a for kind, a, _ in pairs if kind == "\2"}
                    held = {(a, b) for kind, a, b in pairs if kind != "\6" or a in names}
                    if len({a for a, _ in held}) == len(held):
                        runs.append((shift, lo, hi, pairs))
            places = []
            for run in sorted(runs, key=lambda r: r[:2]):
                if places and run[0] - places[-1][-1][0] <= 8:
                    places[-1].append(run)
                else:
                    places.append([run])
            for place in places:
                covered = len({q for _, lo, hi, _ in place for q in range(lo, hi)})
                if max(hi - lo for _, lo, hi, _ in place) >= 13 or covered >= max(n / 2, min(len(told), 8)):
                    same = all(a == b for *_, pairs in place for _, a, b in pairs)
                    out.setdefault((d, k), set()).add("verbatim" if same else "reparameterised")
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    known = ["Tom", "Ann", "Bob", "the", "cat", "ran", "to", "see", "red", "3", "4", "12", "5 km", "7 days", "old", "dog", "and", "sat", "far"]
    text = lambda n: "".join(rng.choice(known) + rng.choice([" ", " ", " ", ". ", ", "]) for _ in range(n))
    items = {i: text(rng.choice([4, 5, 9, 14, 20, 27, 40])) for i in range(25)}
    docs = {}
    for d in range(70):
        words = items[rng.randrange(25)].split(" ")
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(known)
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice(known))
        docs[d] = text(12) + " ".join(words) + text(12)
    told = lambda texts, make: {r.k: r.t for r in spark.createDataFrame(list(texts.items()), "k long, t string").select("k", make(F.col("t")).alias("t")).collect()}
    want = brute_leaks(told(docs, dc.cased_tokens), told(items, lambda c: dc.marked_tokens(c, True)))
    got = found(spark, docs, [items[i] for i in range(25)])
    assert len(want) > 40 and set(got) == set(want) and all(kind in want[pair] for pair, kind in got.items())


def test_dropped_documents(spark):
    docs = cases.docs(spark).unionByName(spark.createDataFrame([(500, "x. " + ITEM, "en", "a", 1)], cases.SCHEMA))
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    kept = dc.drop_leaks(cases.awkward(docs), bench)
    assert kept.count() == docs.count() - 1 and kept.where("doc_id is null").count() == 1


def test_tokens(spark):
    text = "It cost 3.5 km and 20 Dollars, said Tom's friend. Then Ann left \u0001x."
    row = spark.createDataFrame([(text,)], "t string").select(dc.marked_tokens(F.col("t")).alias("a")).first()
    assert row.a == ["it", "cost", "\u00013\u00045", "\u0003km", "and", "\u000120", "\u0003dollars", "said", "\u0002tom", "s", "friend", "then", "\u0002ann", "left", "x"]


PAGES = [
    (1, "https://a.example.org/en/1/x", None), (2, "http://example.org/es/", ""), (3, "https://WWW.Site.com/de/1?x#y", "<p>"), (4, "https://site.com/fr/", None), (5, "no scheme", None), (6, None, None), (7, "https://badorg/x", None),
    (8, "http://one.net/a", '<link href="https://b.com/de/z" rel="canonical">'), (9, "http://two.net/b#f", "<META http-equiv='refresh' content='0; url=//one.net/a'>"),
    (10, "https://two.net/b", None), (11, "http://ok.org/q", '<link rel=canonical href="http://one.net/a">'), (12, "http://three.net/d/e", '<link rel="canonical" href="f">'), (13, "http://three.net/d/f", None),
    (14, "x://h", None), (None, "http://four.net/", None), (14, "x://h", None),
]


def test_urls(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict, r.by) for r in urls.judge(cases.awkward(pages)).collect()), key=str)
    want = sorted([
        (1, "a.example.org", "/en/1/x", "example.org/en/1", "block", "rule"), (2, "example.org", "/es/", "example.org/es/", "block", "rule"), (3, "www.site.com", "/de/1", "com/de/", "block", "rule"),
        (4, "site.com", "/fr/", "com/fr/", "allow", "rule"), (5, "", "", None, "allow", "default"), (6, "", "", None, "allow", "default"), (7, "badorg", "/x", None, "allow", "default"),
        (8, "one.net", "/a", None, "block", "alias"), (9, "two.net", "/b", None, "block", "alias"), (10, "two.net", "/b", None, "block", "alias"), (11, "ok.org", "/q", "org/", "allow", "rule"),
        (12, "three.net", "/d/e", None, "allow", "default"), (13, "three.net", "/d/f", None, "allow", "default"), (14, "h", "", None, "allow", "default"), (0, "four.net", "/", None, "allow", "default"), (14, "h", "", None, "allow", "default"),
    ], key=str)
    assert got == want
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_against_the_oracle(spark, tmp_path):
    assert spark_rows(urls.op4_urls(spark, SMALL)) == duck_rows(SMALL, urls.OP4_SQL)
    pages = spark.createDataFrame([p for p in PAGES if p[1]], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert spark_rows(urls.op4_urls(spark, str(tmp_path))) == duck_rows(None, urls.OP4_SQL, pages=pages.toPandas())


MORE_PAGES = [
    (1, "http://q.net/list/a", '<link rel="canonical" href="?q=2">'), (2, "http://q.net/list/a?q=2", '<link rel=canonical href=https://b.com/de/1>'),
    (3, "http://d.net/x/y/z", '<link rel="canonical" href="../z">'), (4, "http://d.net/x/z", '<meta content="3; URL=./../../../w/." http-equiv=refresh>'), (5, "http://d.net/w/", '<link href="//b.com/de/2" rel="alternate canonical">'),
    (6, "http://e.net/1", "<link rel='canonical' href='/p?a=1&amp;b=2'>"), (7, "http://e.net/p?a=1&b=2", '<link rel=canonical href="http://b.com/de/3">'),
    (8, "http://f.net/1", '<link rel=canonical href="/ok"><link rel="canonical" href="http://b.com/de/4">'),
    (9, "http://g.net/1", '<!-- <link rel=canonical href="http://b.com/de/5"> --><script>"<link rel=canonical href=http://b.com/de/6>"</script>'),
    (10, "http://h.net/1", '<link rel=canonical href="mailto:b@b.com/de/7"><link rel=canonical href="#de"><link rel=canonical href=""><link rel="uncanonical" href="http://b.com/de/8">'),
    (11, "http://i.net", "<meta http-equiv='refresh' content=\"0; url='de/../../x'\">"), (12, "http://i.net/x", '<link rel=canonical href="http://b.com/de/9">'), (13, None, '<link rel=canonical href="http://b.com/de/9">'),
]


def test_references_are_resolved(spark, tmp_path):
    pages = spark.createDataFrame(MORE_PAGES, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == {n: "allow" if n in (9, 10, 13) else "block" for n in range(1, 14)}
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    assert spark_rows(urls.op4_urls(spark, str(tmp_path))) == duck_rows(None, urls.OP4_SQL, pages=pages.toPandas())
