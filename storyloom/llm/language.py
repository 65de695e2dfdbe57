"""Language proportions by expectation-maximisation over n-gram likelihoods, with the language set chosen by penalised likelihood.

Each labelled language gets a distribution over hashed character trigrams. A document is a mixture of languages: EM finds
the proportions that make its trigrams likeliest, and a language stays in the document's set only while dropping it would
cost more log-likelihood than its penalty (a Bayesian information criterion). The largest proportion names the language.

The counts behind the distributions come from a bounded sample of labelled rows (`SAMPLE_ROWS` a language, chosen by a hash of
the key), so the model has a fixed size; it is at most one table of `BUCKETS` columns for each language.

Defined results: a null text and a text without a letter give `und` with score 0, an empty mixture and no row is lost; rows
with a null language teach nothing; very long texts are read whole; rows with a null key are not held out; ties go to the language first in the alphabet;
an empty table gives no rows, and without any labelled text all are `und`; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._common import held_out, read, slices

BUCKETS = 1 << 15
#: About this many labelled rows of each language are counted.
SAMPLE_ROWS = 1500
#: Log-likelihood that each further language of a document's set must gain, times half the logarithm of its trigrams.
PENALTY = 2.0
ROUNDS = 12
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter; one table for each worker."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's letter trigrams and their counts; runs of other characters count as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letters = _letters()[points]
    points = np.where(letters, points, 32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    points = np.concatenate([[32], points[keep], [32]])
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    mixed = (points[:-2] * 2654435761 + points[1:-1] * 40503 * 65537 + points[2:] * 97) & 0xFFFFFFFFFF
    buckets = (mixed ^ (mixed >> 17)) & (BUCKETS - 1)
    found, counts = np.unique(buckets.astype(np.uint16), return_counts=True)
    return found.astype(np.int64), counts.astype(np.float64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): probability of a trigram in a language

    @classmethod
    def of_counts(cls, rows: list[tuple[str, int, int]]) -> LanguageModel:
        languages = sorted({r[0] for r in rows})
        counts = np.zeros((BUCKETS, len(languages)))
        at = {lang: i for i, lang in enumerate(languages)}
        for lang, bucket, n in rows:
            counts[bucket, at[lang]] += n
        smooth = counts + 0.05
        return cls(languages, smooth / smooth.sum(axis=0))

    def mixture(self, text: str | None) -> np.ndarray | None:
        """Proportions by language; None where nothing can be told."""
        buckets, n = trigrams(text or "")
        if not len(buckets) or not self.languages:
            return None
        like = self.table[buckets]
        chosen = np.arange(like.shape[1])
        share, best = _fit(like, n)
        penalty = PENALTY / 2 * np.log(n.sum() + 1)
        while len(chosen) > 1:
            # Drop the language that adds least, as long as what it adds is below the penalty.
            weakest = np.argsort(share, kind="stable")[: 2 if len(chosen) > 2 else len(chosen)]
            trials = []
            for w in weakest:
                rest = np.delete(np.arange(len(chosen)), w)
                trials.append((*_fit(like[:, rest], n), rest))
            share2, ll, rest = max(trials, key=lambda x: x[1])
            if best - ll >= penalty:
                break
            share, best, chosen, like = share2, ll, chosen[rest], like[:, rest]
        out = np.zeros(len(self.languages))
        out[chosen] = share
        return out

    def predict(self, text: str | None) -> tuple[str, float, np.ndarray | None]:
        mix = self.mixture(text)
        if mix is None:
            return UNDETERMINED, 0.0, None
        best = int(np.argmax(mix))
        return self.languages[best], float(min(1.0, mix[best])), mix


def _fit(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the proportions of one document, and its log-likelihood."""
    k = like.shape[1]
    share, total = np.full(k, 1.0 / k), n.sum()
    if k == 1:
        return np.ones(1), float(n @ np.log(like[:, 0]))
    for _ in range(ROUNDS):
        mixed = like @ share
        new = share * (like.T @ (n / mixed)) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(n @ np.log(like @ share))


def train(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Count the trigrams of about sample_rows labelled rows of each language, on the executors.

    Only sums by (language, bucket) reach the driver.
    """
    labelled = docs.where(learn_from & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    scale = 1 << 20
    draw = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("sample")), F.lit(scale))
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample_rows / n) * scale))])
    sampled = labelled.where(draw < rates[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                buckets, n = trigrams(body)
                sums.setdefault(lang, np.zeros(BUCKETS))[buckets] += n
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(total[found].astype(np.int64), pa.int64())], ["lang", "bucket", "n"])

    sums = sampled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return LanguageModel.of_counts([tuple(r) for r in sums.collect()])  # at most BUCKETS rows a language


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score, mixture) for every document; keep names columns that are passed on unread."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS by languages
    languages = model.languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        kind = pa.map_(pa.string(), pa.float64())
        for batch in slices(batches):
            found = [fitted.predict(t) for t in batch.column(text).to_pylist()]
            mixtures = [[] if m is None else [(lang, float(v)) for lang, v in zip(languages, m, strict=True) if v > 0] for _, _, m in found]
            columns = [*(batch.column(c) for c in passed), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(mixtures, kind)]
            yield pa.RecordBatch.from_arrays(columns, [*passed, "lang_pred", "score", "mixture"])

    passed = list(dict.fromkeys([key, *keep]))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))]
    return docs.select(*dict.fromkeys([*passed, text])).mapInArrow(predict, T.StructType([docs.schema[c] for c in passed] + made))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, ~held_out("doc_id"))
    found = identify(docs, model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.to_json("mixture").alias("mixture"))
