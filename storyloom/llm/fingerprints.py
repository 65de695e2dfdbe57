"""Document fingerprints: bottom-k sketches of word-shingle hashes (Broder, 1997; Cohen and Kaplan, 2007).

A sketch keeps the k smallest distinct 64-bit hashes of a text's five-word shingles. The sketch of a union is the k smallest
of both sketches, so parts merge in any order; resemblance, containment and the number of distinct shingles are estimated
from sketches alone, and are exact while a text has at most k distinct shingles.

Defined results: a null text is an empty one; a text of one to four words is one shingle; an empty text has the empty
sketch, whose likeness is 1 to another empty one and 0 to any other; null keys come first in the order; repeated keys
follow one another in the order of their texts; very long texts are read whole; a lone document is its own successor; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import range_bounds, range_bucket, read, shuffle_partitions, slices

K = 256
SHINGLE = 5
_NULL_KEY = -(1 << 63)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values (the one of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """The hash of each word met; emptied when it grows too large, and long words are not kept."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = found
        return found


_HASHES = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """One hash for each run of `width` words, repeats included; a shorter text is one shingle."""
    return shingles_of(word_hashes(text), width)


def shingles_of(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The same from the hashes of the words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total = total * _FACTORS[0] + words[j : j + n] * _FACTORS[1 + j % (len(_FACTORS) - 1)]
    return mixed(total)


class BottomK:
    """The k smallest distinct hashes, ascending."""

    def __init__(self, values: np.ndarray, k: int = K):
        self.values, self.k = values, k

    @classmethod
    def of(cls, text: str, k: int = K, width: int = SHINGLE) -> BottomK:
        hashes = shingle_hashes(text, width)
        if len(hashes) > 8 * k:
            low = np.partition(hashes, 4 * k)[: 4 * k]
            if len(distinct := np.unique(low)) >= k:
                return cls(distinct[:k], k)
        return cls(np.unique(hashes)[:k], k)

    def merge(self, other: BottomK) -> BottomK:
        k = min(self.k, other.k)
        return BottomK(np.union1d(self.values, other.values)[:k], k)

    def distinct(self) -> float:
        """Estimated number of distinct shingles."""
        if len(self.values) < self.k:
            return float(len(self.values))
        return (self.k - 1) * 2.0**64 / (float(self.values[-1]) + 1.0)

    def resemblance(self, other: BottomK) -> float:
        union = self.merge(other).values
        if not len(union):
            return 1.0
        both = np.intersect1d(self.values, other.values, assume_unique=True)
        return float(np.count_nonzero(both <= union[-1])) / len(union)

    def containment(self, other: BottomK) -> float:
        """Estimated share of this text's shingles that the other has."""
        if not len(self.values):
            return 1.0
        union = self.merge(other)
        return min(1.0, self.resemblance(other) * union.distinct() / self.distinct())

    def encode(self) -> str:
        return base64.b64encode(self.values.astype(">u8").tobytes()).decode()

    @classmethod
    def decode(cls, text: str, k: int = K) -> BottomK:
        return cls(np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64), k)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text's first ones."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def sketch_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(key, fingerprint, n_shingles): one sketch for each document, and its estimate of distinct shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [BottomK.of(t or "", k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.encode() for m in made], pa.string()), pa.array([m.distinct() for m in made], pa.float64())], [key, "fingerprint", "n_shingles"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(sketch, f"{key} {kind}, fingerprint string, n_shingles double")


def merge_sketches(sketches: DataFrame, group: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(group, fingerprint, n_shingles): sketches of parts merged by group, first inside each task, then over the tasks.

    A task sends one sketch for each group it has met, so a hot group costs a row for each task and not for each document.
    """
    kind = sketches.schema[group].dataType.simpleString()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, BottomK] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), schema_type), pa.array([s.encode() for s in held.values()], pa.string())], [group, "fingerprint"])
            held.clear()
            return out

        schema_type = None
        for batch in batches:
            schema_type = batch.column(0).type
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = BottomK.decode(s or "", k)
                held[g] = held[g].merge(one) if g in held else one
                if len(held) >= 10_000:
                    yield flush()
        if held:
            yield flush()

    schema = f"{group} {kind}, fingerprint string"
    partial = sketches.select(group, F.col(fingerprint).alias("fingerprint")).mapInArrow(within, schema)
    merged = partial.repartition(group).sortWithinPartitions(group).mapInArrow(within, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [BottomK.decode(s, k).distinct() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.float64())], [group, "fingerprint", "n_shingles"])

    return merged.mapInArrow(count, f"{schema}, n_shingles double")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every document and its edited text, and compare each with its own edit and with its successor by key.

    Texts cross one shuffle, into ranges of the key. The first document of each range is also sent to the range before it
    (that of the first range to the last one), so each task finds every successor it needs without a global window.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(docs, key, shuffle_partitions(spark))
    firsts = sorted((r["part"], r["k"]) for r in range_bucket(keyed.select("k"), "k", bounds, "part").groupBy("part").agg(F.min("k").alias("k")).collect())
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {k0: firsts[i - 1][0] for i, (_, k0) in enumerate(firsts)}  # one entry for each range
    own = F.struct(F.col("own").alias("part"), F.lit(False).alias("tail"))
    lent = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("k")]
    copies = F.when(F.col("k").isin(list(before)), F.array(own, F.struct(lent.alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    ranged = range_bucket(keyed, "k", bounds, "own").select("k", "text", F.explode(copies).alias("to")).select("to.part", "to.tail", "k", "text")
    ordered = ranged.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("tail", "k", "text")

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, str, BottomK] | None = None
        done = False
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_key, body, tail in zip(part.column("k").to_pylist(), part.column("text").to_pylist(), part.column("tail").to_pylist(), strict=True):
                    if done:
                        continue
                    sketch = BottomK.of(body, k)
                    if last is not None:
                        changed = edited(last[1], body)
                        other = BottomK.of(changed, k)
                        rows.append((None if last[0] == _NULL_KEY else last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), last[2].encode(), other.encode(), last[2].resemblance(other), last[2].resemblance(sketch)))
                    last, done = (doc_key, body, sketch), tail
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(fingerprint, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read(spark, sf_dir, "documents"))
