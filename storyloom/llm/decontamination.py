"""Benchmark decontamination by a hash join of template windows, in DataFrame functions only.

Texts and benchmark items are canonicalised to templates: numbers, units after a number and capitalised words become typed
slots; words are lower-cased and punctuation is dropped. Both sides are cut into windows of a few tokens, each in up to three
shapes, whose hashes are joined:

* `slots`: all slots are placeholders (windows of 6 tokens, 4 in items under 6), which finds other names and numbers;
* `words`: capitalised words stand as words (4 tokens, 6 in items of 24 and more), which finds them in any case;
* `values`: numbers stand as they are (4 tokens), for windows with one word or none, such as sums, in items with any word.

A window needs `LEAST_WORDS` words beside its slots, `SLOT_WORDS` in the first shape. What a capital means depends on no context
in a document: an item's sentence openings match as word or as name. In scripts without blanks each character is a token.

Windows that touch on one diagonal (the same shift between document and item) make a run, and a run's slots must be filled by a
function of the item's fillings: equal fillings are a verbatim copy; other consistent fillings a re-parameterised question; an
inconsistent run counts for nothing. Runs on neighbouring diagonals (words put in or left out between them) are put together. A
pair is reported if one of its runs has `RUN` tokens, or its runs cover at least half of the item's tokens and `WINDOW` of
those that lie in a window.

Defined results: null, empty and slot-only texts match nothing; items under `SHORTEST` tokens are found where they are the
whole document, value for value; items with equal templates are each reported; of repeated keys the rows are taken as one
document (its windows count once); very long texts are read whole; of equally good places the first counts; null keys are left
out, for a result names its document; an empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm._common import read, stage

WINDOW = 8
SHORTEST = 4
#: Words that a window must have beside its slots, and where all its capitalised words are slots.
LEAST_WORDS, SLOT_WORDS = 2, 3
SHARE = 0.5
#: Tokens of a run that is reported whatever the item's length.
RUN = 13
#: Places by which neighbouring diagonals may differ.
DRIFT = 8
#: Benchmark windows up to which their side of the join is broadcast, and up to which at least their hashes are; beyond that both
#: sides are shuffled.
BROADCAST_WINDOWS, BROADCAST_HASHES = 100_000, 2_000_000

# Unit words that count as a slot after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles g kg mg lb lbs oz pounds ounces grams kilograms t tons ml l litres liters gallons "
    "s sec seconds min minutes h hr hours day days week weeks month months year years percent usd eur gbp dollars euros cents pence "
    "mph kmh hz khz mhz ghz w kw v a j kj n pa k c f b kb mb gb tb"
)
#: Characters of scripts that put no blanks between words: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Marks of slots: they stand before the value inside a token, so one token holds both its type and its filling. POINT stands
#: for the separators inside a number.
NUMBER, NAME, UNIT, POINT = "\u0001", "\u0002", "\u0003", "\u0004"
_SLOT_END = "\u0005"
#: Stands before a capitalised word that may be a name or just open a sentence; such a token is a word and can fill a name's slot.
OPENING = "\u0006"


def _clean(text: Column) -> Column:
    controls = NUMBER + NAME + UNIT + POINT + OPENING
    return F.when(text.rlike(f"[{controls}]"), F.translate(text, controls, " " * len(controls))).otherwise(text)


def _line(named: Column) -> Column:
    """The tokens, with one blank between them, of a text whose capitalised words are marked."""
    named = F.when(named.rlike(f"[{UNSPACED}]"), F.regexp_replace(named, f"([{UNSPACED}])", " $1 ")).otherwise(named)
    whole = F.regexp_replace(named, r"(\d)[.,](?=\d)", "$1" + POINT)
    numbered = F.regexp_replace(whole, rf"(?<![\p{{L}}\p{{N}}{POINT}])(\d[\d{POINT}]*)", " " + NUMBER + "$1 ")
    units = F.regexp_replace(numbered, rf"(?i)({NUMBER}[\d{POINT}]+ +){NAME}?({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", "$1" + UNIT + "$2 ")
    marked = F.when(named.rlike("[0-9]"), units).otherwise(named)
    return F.trim(F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}{NUMBER}-{OPENING}]+", " "))


def _parts(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def marked_line(text: Column, openings: bool = False) -> Column:
    """Tokens with one blank between them: lower-cased words, and slot mark plus lower-cased value for numbers, names and units.

    A name is a capitalised word inside a sentence. With openings, the other capitalised words have a mark, too.
    """
    named = F.regexp_replace(_clean(text), r"(\p{Lu})(?<=[\p{L}\p{N},;:]\s\p{Lu})(?=\p{L})", NAME + "$1")
    if openings:
        named = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}})(?=\p{{L}})", OPENING + "$1")
    return _line(named)


def cased_line(text: Column) -> Column:
    """The same with every capitalised word a name, whatever stands before it."""
    return _line(F.regexp_replace(_clean(text), r"(?<![\p{L}\p{N}])(\p{Lu})(?=\p{L})", NAME + "$1"))


def marked_tokens(text: Column, openings: bool = False) -> Column:
    return _parts(marked_line(text, openings))


def cased_tokens(text: Column) -> Column:
    return _parts(cased_line(text))


def plain(token: Column) -> Column:
    """The token without the mark of a name or an opening."""
    return F.translate(token, NAME + OPENING, "")


def _kind(token: Column) -> Column:
    return F.substring(token, 1, 1)


SLOTS, WORDS, VALUES, WHOLE = "slots", "words", "values", "whole"


def _shape(line: Column, shape: str) -> Column:
    """The template of a line of tokens, in which names and openings have one mark."""
    if shape == SLOTS:
        return F.regexp_replace(line, rf"([{NUMBER}{NAME}{UNIT}])[^ ]+", "$1")
    values = F.translate(line, NAME, "")
    if shape == WORDS:
        return F.when(F.instr(line, NUMBER) > 0, F.regexp_replace(values, rf"([{NUMBER}{UNIT}])[^ ]+", "$1")).otherwise(values)
    return values


def _keys(tokens: str, at: Column, width: int) -> Column:
    """The hash of so many tokens (4 or 6) from a place on, null where the line ends before; that of six is made from that of four."""
    get = lambda k: F.get(tokens, at + k)
    if width == 4:
        return F.when(get(3).isNotNull(), F.xxhash64(*map(get, range(4)))).alias(f"{tokens}4")
    return F.when(get(5).isNotNull(), F.xxhash64(F.col(f"{tokens}4"), get(4), get(5))).alias(f"{tokens}6")


def _whole_key(line: Column, size: Column) -> Column:
    """The hash of a line that is shorter than any window."""
    return F.when((size > 0) & (size < SHORTEST), F.xxhash64(F.lit(WHOLE), plain(line)))


def _plan(size: int) -> dict[str, int]:
    """The widths of an item's windows by shape; they are the same from one of the sizes 4, 6 and 24 up to the next."""
    return {SLOTS: 4 if size < 6 else 6, WORDS: 4 if size < 24 else 6, VALUES: 4}


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(h, item_id, n_tokens, n_covered, n_windows, item_pos, shape, width, item_tokens): the windows by which each item is found.

    n_covered counts the item's tokens that lie in any of its windows.
    """
    tokens = stage(items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), marked_tokens(F.coalesce(F.col(text), F.lit("")), True).alias("tokens")), "benchmark-tokens")
    size, at = F.size("tokens"), F.col("item_pos")
    line = F.translate(F.array_join("tokens", " "), OPENING, NAME)
    parts = [tokens.select("item_id", "tokens", F.lit(WHOLE).alias("shape"), size.alias("width"), F.lit(0).alias("item_pos"), _whole_key(line, size).alias("h")).where("h is not null")]
    for lo, hi in ((SHORTEST, 6), (6, 24), (24, 1 << 30)):
        sized = tokens.where((size >= lo) & (size < hi))
        for shape, width in _plan(lo).items():
            cut = sized.withColumn("own", F.split(_shape(line, shape), " ")).select("*", F.explode(F.sequence(F.lit(0), size - width)).alias("item_pos"))
            cut = cut.select("*", _keys("own", at, 4)).select("*", _keys("own", at, 6))
            words = F.size(F.filter(F.slice("own", at + 1, width), lambda t: t >= _SLOT_END))
            # A window with one word or none is met by its values; one with more words by its template.
            worded = F.exists("own", lambda t: t >= _SLOT_END)
            enough = (words < LEAST_WORDS) & worded if shape == VALUES else words >= (SLOT_WORDS if shape == SLOTS else LEAST_WORDS)
            parts.append(cut.where(enough).select("item_id", "tokens", F.lit(shape).alias("shape"), F.lit(width).alias("width"), "item_pos", F.col(f"own{width}").alias("h")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = stage(every.select("item_id", size.alias("n_tokens"), "item_pos", "shape", "width", F.slice("tokens", at + 1, F.col("width")).alias("item_tokens"), "h"), "benchmark-windows")
    spread = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(at, at + F.col("width") - 1)))))
    counts = found.groupBy("item_id").agg(F.countDistinct("item_pos").cast("int").alias("n_windows"), spread.alias("n_covered"))
    return found.join(counts, "item_id").select("h", "item_id", "n_tokens", "n_covered", "n_windows", "item_pos", "shape", "width", "item_tokens")


def matched_windows(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, n_windows, pos, item_pos, doc_tokens, item_tokens) of every window that both sides have.

    Each place of a document has a hash for each shape and width that the benchmark uses; the places stay in generated code up
    to the join with the hashes. Generated code holds all rows that it makes of one document, so none of them has the document's
    line, and each place and hash makes one row: the items that share a window are met behind a shuffle.
    """
    windows = stage(windows, "benchmark-keys")
    used, n = sorted((r["shape"], r["width"]) for r in windows.select("shape", "width").distinct().collect()), windows.count()  # a handful
    lined = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), cased_line(F.col(text)).alias("line"))
    lined = lined.withColumn("of", F.xxhash64("line"))
    # Lines without a number have the same words and values, whose keys are then taken once.
    values = F.when(F.instr("line", NUMBER) > 0, F.split(_shape(F.col("line"), VALUES), " "))
    shaped = lined.select("doc_id", "line", "of", F.split(_shape(F.col("line"), SLOTS), " ").alias(SLOTS), F.split(_shape(F.col("line"), WORDS), " ").alias(WORDS), values.alias(VALUES))
    if n <= broadcast_hashes:
        shaped = shaped.select("*", F.coalesce(VALUES, WORDS).alias("plain"))
    # The outer form: for the inner one Spark infers a filter on the array's size, and computes the tokens twice.
    placed = shaped.select("*", F.posexplode_outer(WORDS).alias("pos", "token"))
    at, widths = F.col("pos"), {shape: [w for s, w in used if s == shape] for shape in (SLOTS, WORDS, VALUES)}
    four = placed.select("*", *[_keys(shape, at, 4) for shape, w in widths.items() if w])
    six = four.select("*", *[_keys(shape, at, 6) for shape, w in widths.items() if 6 in w])
    listed = [*(F.col(f"{shape}{w}") for shape, every in widths.items() for w in every), F.when((at == 0) & (F.col("token") != ""), _whole_key(F.col("line"), F.size(WORDS)))]
    hashed = F.explode(F.array(*listed)).alias("h")
    of_item = ["item_id", "n_tokens", "n_covered", "n_windows", "pos", "item_pos"]
    if n <= broadcast_hashes:
        keyed = six.select("doc_id", "plain", "pos", hashed)
        kept = keyed.join(F.broadcast(windows.select("h").distinct()), "h", "left_semi").select("doc_id", "pos", "h", F.slice("plain", at + 1, WINDOW).alias("near")).repartition("doc_id", "pos")
        met = kept.join(F.broadcast(windows) if n <= broadcast_windows else windows, "h")
        return met.select("doc_id", *of_item, F.slice("near", F.lit(1), F.col("width")).alias("doc_tokens"), "item_tokens")
    # Hashes alone are shuffled; lines meet again the windows that were found in them.
    met = six.select("doc_id", "of", "pos", hashed).join(windows, "h")
    return met.join(lined, ["doc_id", "of"]).select("doc_id", *of_item, F.slice(F.split("line", " "), at + 1, F.col("width")).alias("doc_tokens"), "item_tokens")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, run: int = RUN, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, item_id, kind, matched, n_windows, n_slots, position) for each leaked item of each document.

    kind is `verbatim` or `reparameterised`; position is the first token of the best place.
    """
    found = matched_windows(docs, item_windows(items, item_key, item_text), key, text, broadcast_windows, broadcast_hashes)
    paired = F.zip_with("item_tokens", "doc_tokens", lambda i, d: F.struct(_kind(i).alias("k"), plain(i).alias("i"), plain(d).alias("d")))
    filled = F.filter(paired, lambda p: p["k"].isin(NUMBER, NAME, UNIT) | ((p["k"] == OPENING) & (p["i"] != p["d"])))
    places = found.select("doc_id", "item_id", "n_tokens", "n_covered", "n_windows", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", F.size("item_tokens").alias("width"), filled.alias("slots")).distinct()
    # A diagonal has a few windows for each of the item's places, whatever the length of the document.
    diagonal = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos", "width")
    reached = F.max(F.col("item_pos") + F.col("width")).over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("item_pos") > reached, F.lit(False)).cast("int")
    numbered = places.withColumn("apart", apart).withColumn("run", F.sum("apart").over(diagonal))
    runs = numbered.groupBy("doc_id", "item_id", "n_tokens", "n_covered", "n_windows", "shift", "run").agg(
        F.collect_set("item_pos").alias("starts"), F.min("item_pos").alias("lo"), F.max(F.col("item_pos") + F.col("width")).alias("hi"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    # An opening that differs is held against the names only if it is one of them.
    names = F.transform(F.filter("slots", lambda p: p["k"] == NAME), lambda p: p["i"])
    checked = F.transform(F.filter("slots", lambda p: (p["k"] != OPENING) | F.array_contains(F.col("names"), p["i"])), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    of = runs.withColumn("names", names).withColumn("checked", F.array_distinct(checked))
    consistent = of.where(F.size(F.array_distinct(F.transform("checked", lambda p: p["i"]))) == F.size("checked")).drop("names", "checked", "run")
    near = Window.partitionBy("doc_id", "item_id").orderBy("shift", "lo")
    jump = F.coalesce(F.col("shift") - F.lag("shift").over(near) > DRIFT, F.lit(False)).cast("int")
    placed = consistent.withColumn("jump", jump).withColumn("place", F.sum("jump").over(near))
    together = placed.groupBy("doc_id", "item_id", "n_tokens", "n_covered", "n_windows", "place").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("starts")))).alias("matched"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("lo"), F.col("hi") - 1))))).alias("covered"),
        F.max(F.col("hi") - F.col("lo")).alias("longest"),
        F.min(F.col("lo") + F.col("shift")).alias("position"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    enough = (F.col("longest") >= run) | (F.col("covered") >= F.greatest(F.col("n_tokens") * share, F.least(F.col("n_covered"), F.lit(window)).cast("double")))
    kind = F.when(F.forall("slots", lambda p: p["i"] == p["d"]), "verbatim").otherwise("reparameterised")
    kept = together.where(enough).withColumn("kind", kind)
    best = F.max_by(F.struct("kind", "matched", F.size("slots").alias("n_slots"), "position"), F.struct("matched", F.col("kind") == "verbatim", -F.col("position")))
    return kept.groupBy("doc_id", "item_id", "n_windows").agg(best.alias("b")).select("doc_id", "item_id", "b.kind", "b.matched", "n_windows", "b.n_slots", "b.position")


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that leak no benchmark item; documents with a null key are kept."""
    leaked = stage(leaks(docs, items, key, text).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked-keys")
    return docs.join(leaked, docs[key] == leaked["_leaked"], "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
