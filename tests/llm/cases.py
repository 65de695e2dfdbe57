"""Documents that every operator must bear: nulls, empty and long texts, ties, repeats, extra and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, lang=0):
    rng = random.Random(seed)
    parts = [("an", "er", "th", "on", "ing", "re"), ("eau", "que", "ier", "oi", "ment", "ré"), ("sch", "ein", "ung", "keit", "ö", "ver")][lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows():
    body = words(120, 1)
    out = [
        (5, body, "en", "a"), (3, body, "en", "a"), (4, body.replace(" ", "  ", 3), "en", "a"), (9, body + " extra tail", "en", "b"), (1, None, "en", "a"), (2, "", None, None), (7, "   \n\t ", "en", "a"),
        (8, "12 34 !!", "fr", "a"), (10, "one", "en", "a"), (11, "one two", "en", "a"), (12, words(20_000, 2), "en", "a"), (13, words(80, 3, 1), "fr", "a"), (14, words(80, 4, 2), "de", "a"),
        (15, "É’s ΣΑΣ x² — “yes” ½ 😀 <|endoftext|>\n\nno\n", "fr", "a"), (None, "a row without a key", "en", "a"), (16, words(200, 5), "en", "a"), (16, words(200, 5), "en", "a"),
    ]
    for i in range(30):
        lang = i % 3
        out.append((100 + i, words(60, 100 + i, lang), ("en", "fr", "de")[lang], "b"))
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def awkward(df):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "score spans mixture rep fp key kind part block length shard slot size row anchor tokens pos same tail k own _pos root".split()
    return df.select("*", *[F.lit(n).alias(n) for n in names])


def none(spark):
    return spark.createDataFrame([], SCHEMA)
