"""Toxic spans by a linear-chain conditional random field; marginals add up to document scores and offending offsets.

Labels mark documents, so tokens are labelled first: in a bounded sample of labelled documents, a token of a toxic document is
toxic if its form, or its stem (first letters), is in toxic documents at least `LIFT` times as often as in clean ones and more
often than chance allows (`marks`: a false discovery rate of `FALSE_MARKS` over all forms, one rule for samples of any size);
all other tokens are not. The CRF (two states; features: hashed form and stems) is trained on these sequences by gradient
ascent with forward-backward expectations. Scoring tags whole texts: the marginal odds of a token come from one forward and one
backward pass, and a document's score is a logistic function of its largest marginal log-odds, of its expected number of
toxic tokens and of its length. That function is fitted on whole documents of the sample from which the CRF does not learn.

The sample: `SAMPLE_TOXIC` and `SAMPLE_CLEAN` rows and `SAMPLE_POINTS` code points of each kind at most, drawn by a hash of key
and text whatever a text's length. It is cut into pieces of `PIECE` code points where it lies; of a text over `LONG_POINTS` so
many pieces are drawn as make about that length. All whole texts are scored.

Defined results: null and empty texts have no tokens and get the score of a document without any toxic token; very long texts
are scored whole; rows with a null key are not held out and labels without a document, null labels and labels of null texts
teach nothing; of repeated labels of a key the largest counts, and of repeated rows of a key each teaches; without labelled
documents of both kinds every score is 0; words that stand out equally often are all marks; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._common import held_out, read, slices, stage

FEATURES = 1 << 16
#: Bounds of the sample of each kind: rows and code points.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_POINTS = 800, 1200, 3_000_000
#: Code points of a piece that the CRF learns from, and of a text above which only some of its pieces are drawn.
PIECE, LONG_POINTS = 4_000, 64_000
LIFT, FALSE_MARKS = 8.0, 0.003
#: Letters of the stems that are features and may be marks.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word: the form and its stems."""
    names = ["w" + word, *[f"s{word[:n]}" for n in STEMS if len(word) >= n]]
    return [xxhash.xxh32_intdigest(n) & (FEATURES - 1) for n in names]


@dataclass
class ToxicityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float32))
    bias: float = -8.0
    #: Log-potential of staying toxic, of entering and of leaving; staying clean is 0.
    moves: tuple[float, float, float] = (0.0, 0.0, 0.0)
    #: Intercept and slopes of what summary() gives.
    scale: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)

    def document_score(self, told: tuple[float, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] + np.dot(self.scale[1:], told), -30, 30))))


def summary(log_odds: np.ndarray) -> tuple[float, float, float]:
    """The largest log-odds, log(1 + expected toxic tokens) and log(1 + tokens) of a document."""
    if not len(log_odds):
        return -15.0, 0.0, 0.0
    expected = (1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))).sum()
    return float(np.clip(log_odds.max(), -15, 15)), float(np.log1p(expected)), float(np.log1p(len(log_odds)))


def chain(emissions: list[np.ndarray], moves: tuple[float, float, float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each sequence, the forward and the backward log-odds of `toxic` at each token, the token's own emission in neither.

    Sequences are stepped through together, the longest first, so a step is one array operation on those not yet ended.
    """
    stay, enter, leave = (float(np.exp(np.clip(m, -20, 20))) for m in moves)
    lengths = np.array([len(e) for e in emissions])
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(sorted_lengths)[:-1]]).astype(np.int64)
    flat = np.concatenate([emissions[i] for i in order]) if len(order) else np.zeros(0)
    forward, backward = np.zeros(len(flat)), np.zeros(len(flat))
    longest = int(sorted_lengths[0]) if len(order) else 0
    going = np.searchsorted(-sorted_lengths, -np.arange(1, longest + 1), side="right")
    odds = np.zeros(len(order))
    for t in range(longest - 1):
        n = going[t + 1]
        r = np.exp(np.clip(odds[:n] + flat[starts[:n] + t], -60, 60))
        odds[:n] = np.log((enter + r * stay) / (1 + r * leave))
        forward[starts[:n] + t + 1] = odds[:n]
    ends, odds = starts + sorted_lengths - 1, np.zeros(len(order))
    for t in range(longest - 1):
        n = going[t + 1]
        r = np.exp(np.clip(odds[:n] + flat[ends[:n] - t], -60, 60))
        odds[:n] = np.log((leave + r * stay) / (1 + r * enter))
        backward[ends[:n] - t - 1] = odds[:n]
    out: tuple[list, list] = ([None] * len(order), [None] * len(order))
    for at, i in enumerate(order):
        span = slice(starts[at], starts[at] + sorted_lengths[at])
        out[0][i], out[1][i] = forward[span], backward[span]
    return out


def marks(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> set[str]:
    """Forms that mark toxic documents, from the documents of each kind that have them.

    If a form were as frequent in both kinds, so many of its documents would be toxic with a probability of at most
    exp(-N KL(share || rate)) (Chernoff). Forms are taken by the false discovery rate (Benjamini and Hochberg) over those with
    documents enough to be told apart at all (Tarone).
    """
    rate = n_toxic / max(1, n_toxic + n_clean)
    forms = sorted(f for f, n in toxic.items() if rate ** (n + clean[f]) < 1e-3)
    n = np.array([toxic[f] for f in forms], dtype=float)
    both = n + np.array([clean[f] for f in forms], dtype=float)
    share = n / np.maximum(both, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
    p = np.where(share > rate, np.exp(-both * kl), 1.0)
    tested = sum(1 for f, c in clean.items() if f not in toxic and rate ** c < 1e-3) + len(forms)
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= FALSE_MARKS * np.arange(1, len(p) + 1) / max(1, tested))
    most = p[order[passed[-1]]] if len(passed) else -1.0
    lifted = n * n_clean >= LIFT * (both - n + 0.5) * n_toxic
    return {f for f, ok in zip(forms, (p <= most) & lifted, strict=True) if ok}


def label_tokens(docs: list[list[str]], toxic: list[int], of: list[int]) -> list[np.ndarray]:
    """1 for each token of a toxic document whose form or stem marks toxic documents, else 0; of numbers each piece's document."""
    stems = lambda w: {w, *(w[:n] + "*" for n in STEMS if len(w) > n)}
    forms_of: dict[int, set[str]] = {}
    kinds = dict(zip(of, toxic, strict=True))
    for words, d in zip(docs, of, strict=True):
        forms_of.setdefault(d, set()).update(*map(stems, set(words)))
    seen = {0: Counter(), 1: Counter()}
    for d, forms in forms_of.items():
        seen[kinds[d]].update(forms)
    found = marks(seen[1], seen[0], sum(kinds.values()), len(kinds) - sum(kinds.values()))
    return [np.array([bool(y) and not found.isdisjoint(stems(w)) for w in words], dtype=np.float64) for words, y in zip(docs, toxic, strict=True)]


def fit(pieces: list[str], toxic: list[int], of: list[int], rounds: int = 60) -> ToxicityModel:
    """Train the chain on the pieces of a bounded sample that has documents of both kinds; of numbers each piece's document."""
    model = ToxicityModel()
    docs = [[w.lower() for w in _WORD.findall(t)] for t in pieces]
    if not (0 in toxic and 1 in toxic and any(docs)):
        return model
    gold = label_tokens(docs, toxic, of)
    forms = sorted({w for words in docs for w in words})
    number = {w: i for i, w in enumerate(forms)}
    listed = [features(w) for w in forms]
    width = max(map(len, listed), default=1)
    table = np.full((len(forms), width), FEATURES, dtype=np.int64)
    for i, f in enumerate(listed):
        table[i, : len(f)] = f
    tokens = [np.array([number[w] for w in words], dtype=np.int32) for words in docs]
    del docs, listed, number
    flat, truth = np.concatenate(tokens), np.concatenate(gold)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *map(len, tokens)])[:-1].clip(max=max(len(flat) - 1, 0))] = True
    after = ~first[1:]  # a token that follows another of its document
    true_moves = [float((a * b)[after].sum()) for a, b in ((truth[:-1], truth[1:]), (1 - truth[:-1], truth[1:]), (truth[:-1], 1 - truth[1:]))]
    w, params = np.zeros(FEATURES + 1), np.array([-4.0, 0.0, 0.0, 0.0])
    speed = [np.zeros_like(w), np.zeros_like(params)]
    size = len(flat)
    for step in range(rounds):
        emit = params[0] + w[table].sum(axis=1)[flat]
        emissions = np.split(emit, np.cumsum([len(t) for t in tokens])[:-1])
        fwd, bwd = (np.concatenate(x) for x in chain(emissions, tuple(params[1:])))
        p = 1 / (1 + np.exp(-np.clip(fwd + emit + bwd, -30, 30)))
        gap = truth - p
        by_form = np.bincount(flat, weights=gap, minlength=len(forms))
        g = np.bincount(table.ravel(), weights=np.repeat(by_form, width), minlength=FEATURES + 1) - 1e-3 * w
        # Expected moves of neighbouring tokens, from the forward odds of the first and the backward odds of the second.
        a, b = np.clip(fwd + emit, -40, 40)[:-1][after], np.clip(emit + bwd, -40, 40)[1:][after]
        moved = [a + b + params[1], b + params[2], a + params[3]]
        most = np.maximum(np.maximum(moved[0], moved[1]), np.maximum(moved[2], 0))
        moved = [np.exp(m - most) for m in moved]
        whole = moved[0] + moved[1] + moved[2] + np.exp(-most)
        gp = np.array([gap.sum(), *(true_moves[i] - (moved[i] / whole).sum() - 1e-2 * params[i + 1] for i in range(3))])
        del a, b, moved, most, whole, fwd, bwd, p
        for value, grad, fast in ((w, g, speed[0]), (params, gp, speed[1])):
            fast += grad * grad
            value += 0.5 * grad / (np.sqrt(fast) + 1e-8) * (1.0 if step else 0.5)
        w[FEATURES] = 0.0
        if np.abs(gap).sum() < 1e-4 * size / 100:
            break
    return ToxicityModel(w[:FEATURES].astype(np.float32), float(params[0]), tuple(map(float, params[1:])))


def calibrate(told: list[tuple[float, ...]], toxic: list[int], share: float) -> tuple[float, ...]:
    """Intercept and slopes of a ridge logistic regression, the rows weighted so that `share` of them are toxic.

    More evidence never lowers a score: a slope of it that would be negative is left at 0. That of the length is free.
    """
    x, y = np.array([[1.0, *t] for t in told]), np.array(toxic, dtype=float)
    ridge = np.array([1e-3, *[1e-2] * (x.shape[1] - 1)])
    weight, free = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())), np.ones(x.shape[1], bool)
    while True:
        beta = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps
            q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
            slope = x.T @ (weight * (y - q)) - ridge * beta
            beta[free] += np.linalg.solve(hess[np.ix_(free, free)], slope[free])
        against = np.flatnonzero((beta < 0) & np.array([i in (1, 2) for i in range(len(beta))]))
        if not len(against):
            return tuple(map(float, beta))
        free[against] = False


class _Emissions(dict):
    """The emission of each word met, in any case; emptied when it grows too large."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.bias, self.weights = model.bias, model.weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[word] = self.bias + sum([self.weights[f] for f in features(word.lower())])
        return found


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.emissions = model, _Emissions(model)

    def log_odds(self, texts: list[str]) -> list[np.ndarray]:
        """The marginal log-odds of each word of each whole text."""
        emissions = []
        for text in texts:
            words = _WORD.findall(text)
            emissions.append(np.fromiter(map(self.emissions.__getitem__, words), np.float64, len(words)))
        return [e + f + b for e, f, b in zip(emissions, *chain(emissions, self.model.moves), strict=True)]

    def spans(self, text: str, log_odds: np.ndarray) -> list[tuple[int, int, float]]:
        """First and past-the-last code point of each run of toxic words, and its largest marginal."""
        found: list[tuple[int, int, float]] = []
        if len(log_odds) and log_odds.max() >= 0:
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
            places = [m.span() for m in _WORD.finditer(text)]
            last = -2
            for i in np.flatnonzero(p >= SPAN_MARGINAL):
                if i == last + 1:
                    found[-1] = (found[-1][0], places[i][1], max(found[-1][2], float(p[i])))
                else:
                    found.append((*places[i], float(p[i])))
                last = i
        return found


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on a sample of the labelled documents (see above); only its pieces and three numbers a document reach the driver."""
    marked = labels.where(learn_from & F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max("toxic").cast("int").alias("_y")).where("_y in (0, 1)")
    h = F.xxhash64(F.col(key).cast("string"), F.col(text))
    known = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), h.alias("_h"), F.char_length(F.col(text)).alias("_n")).join(marked, "_k")  # no text is moved
    sizes = {r["_y"]: (r["n"], r["p"]) for r in known.groupBy("_y").agg(F.count("*").alias("n"), F.sum("_n").alias("p")).collect()}
    if set(sizes) != {0, 1}:
        return ToxicityModel()
    scale = 1 << 20
    rate = {y: int(min(1.0, most / sizes[y][0], SAMPLE_POINTS / max(1, sizes[y][1])) * scale) for y, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC))}
    drawn = known.where(F.pmod(F.xxhash64("_h", F.lit("sample")), F.lit(scale)) < F.when(F.col("_y") == 1, rate[1]).otherwise(rate[0])).distinct()
    apart = F.pmod(F.xxhash64("_h", F.lit("apart")), F.lit(4)) == 0
    # About SAMPLE_TOXIC + SAMPLE_CLEAN rows at any size of the input.
    met = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")).join(F.broadcast(drawn), F.col("_key") == F.col("_k"))
    sample = stage(met.where(F.xxhash64(F.col("_key").cast("string"), "_t") == F.col("_h")).select("_k", "_h", "_n", "_y", "_t", apart.alias("_apart")), "toxicity-sample")
    # Which documents the CRF does not learn from; if those are of one kind, all are used for both.
    kinds = {r["_y"] for r in sample.where("_apart").select("_y").distinct().collect()}, {r["_y"] for r in sample.where("not _apart").select("_y").distinct().collect()}
    taught, judged = (sample.where("not _apart"), sample.where("_apart")) if kinds == ({0, 1}, {0, 1}) else (sample, sample)
    starts = F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)), F.lit(PIECE))
    cut = taught.select(F.col("_k").cast("string").alias("k"), F.col("_h").alias("h"), "_y", "_n", "_t", F.explode(starts).alias("at"))
    long_rate = F.lit(LONG_POINTS * scale).cast("double") / F.greatest(F.col("_n"), F.lit(LONG_POINTS))
    kept = cut.where(F.pmod(F.xxhash64("k", "h", "at"), F.lit(scale)) < long_rate).select("k", "h", "at", "_y", F.col("_t").substr(F.col("at"), F.lit(PIECE)).alias("piece"))
    rows = sorted(tuple(r) for r in kept.collect())
    number = {kh: i for i, kh in enumerate(dict.fromkeys((r[0], r[1]) for r in rows))}
    model = fit([r[4] for r in rows], [r[3] for r in rows], [number[r[0], r[1]] for r in rows])
    told = score_documents(judged.select("_y", "_t"), model, "_y", "_t").select("_y", "top", "expected", "tokens").collect()
    model.scale = calibrate([tuple(r)[1:] for r in told], [r[0] for r in told], sizes[1][0] / (sizes[0][0] + sizes[1][0]))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, top, expected, tokens, spans) for every document; spans are the offending offsets with their largest marginal."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    passed = list(dict.fromkeys([key, *keep]))
    names = ["score", "top", "expected", "tokens", "spans"]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(handle.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            odds = scorer.log_odds(texts)
            told = [summary(o) for o in odds]
            numbers = [pa.array([scorer.model.document_score(t) for t in told], pa.float64()), *(pa.array(c, pa.float64()) for c in zip(*told, strict=True))]
            spans = [[{"start": a, "end": b, "marginal": p} for a, b, p in scorer.spans(t, o)] for t, o in zip(texts, odds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *numbers, pa.array(spans, kind)], [*passed, *names])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())])
    made = [*(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField("spans", T.ArrayType(span))]
    return docs.select(*dict.fromkeys([*passed, text])).mapInArrow(tag, T.StructType([docs.schema[c] for c in passed] + made))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = score_documents(docs, train(docs, labels, ~held_out("doc_id")))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted, F.to_json("spans").alias("spans"))
