"""Packing documents into sequences of fixed capacity: Martello-Toth dominance reduction, then best fit (decreasing).

Only a piece's length matters to the packing, so the plan is made on the histogram of lengths, which has at most `capacity`
entries for any number of documents. The reduction permanently fixes small sets of lengths that provably dominate every
alternative (Martello and Toth, 1990); best-fit-decreasing packs what is left. The plan is a short list of rules, "pieces lo
to hi of length s go k to a sequence from sequence b on, at offset o"; Spark numbers the pieces of each length and joins
them with the rules. No list of documents passes through the driver.

Defined results: a null text is an empty one and takes its end id alone; repeated rows are packed one by one; an empty table
gives no rows; extra columns are ignored. Ties between pieces of a length go by key, then piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import give_back, global_positions, read, stage
from storyloom.llm._encode import GENERATION, encoder, vocabulary

CAPACITY = 1024


@dataclass(frozen=True)
class Rule:
    """Pieces lo .. hi - 1 of a length go per_seq to a sequence, from first_seq on, at offset."""

    length: int
    lo: int
    hi: int
    first_seq: int
    per_seq: int
    offset: int


class Plan:
    def __init__(self, capacity: int, counts: dict[int, int]):
        if any(not 0 < s <= capacity for s in counts):
            raise ValueError("lengths must lie in 1 .. capacity")
        self.capacity = capacity
        self.left = {s: n for s, n in sorted(counts.items()) if n}
        self.used = dict.fromkeys(self.left, 0)
        self.rules: list[Rule] = []
        self.sequences = 0
        self.fixed = 0

    def _place(self, length: int, n: int, first_seq: int, per_seq: int, offset: int) -> None:
        lo = self.used[length]
        self.rules.append(Rule(length, lo, lo + n, first_seq, per_seq, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, members: list[int]) -> None:
        """As many sequences with just these members as the counts allow."""
        need = {s: members.count(s) for s in members}
        times = min(self.left[s] // k for s, k in need.items())
        offset = 0
        for s, k in need.items():
            self._place(s, times * k, self.sequences, k, offset)
            offset += s * k
        self.sequences += times
        self.fixed += times

    def reduce(self) -> None:
        """Fix every set that dominates all other feasible sets of its largest member.

        For a length s with room r = capacity - s, let a be the largest other length that fits:
        - nothing fits: {s};
        - s + a fills the sequence, or no two others fit together: {s, a}, since any other partner can be exchanged for a;
        - at most two others fit: {s, a} if a is at least as large as the best pair; {s, a, b} with the largest b that still
          fits, if no feasible pair has a smaller member above b.
        """
        for s in sorted(self.left, reverse=True):
            while self.left.get(s):
                members = self._dominating(s)
                if members is None:
                    break
                self._fix(members)

    def _dominating(self, s: int) -> list[int] | None:
        room = self.capacity - s
        free = dict(self.left)
        free[s] -= 1
        sizes = [x for x, n in free.items() if n and x <= room]
        if not sizes:
            return [s]
        a = sizes[-1]
        smallest = [x for x in sizes[:3] for _ in range(min(free[x], 3))][:3]
        if a == room or len(smallest) < 2 or sum(smallest[:2]) > room:
            return [s, a]
        if len(smallest) == 3 and sum(smallest) <= room:
            return None

        def partner(x: int, most: int) -> int | None:
            """The largest length <= most that fits beside x."""
            i = bisect.bisect_right(sizes, min(room - x, most))
            while i and sizes[i - 1] == x and free[x] < 2:
                i -= 1
            return sizes[i - 1] if i else None

        pairs = [(x, y) for x in sizes if (y := partner(x, x)) is not None]
        if a >= max(x + y for x, y in pairs):
            return [s, a]
        b = partner(a, a)
        if b is not None and b >= max(y for _, y in pairs):
            return [s, a, b]
        return None

    def best_fit(self) -> None:
        """Best-fit-decreasing on equal groups of open sequences: (first sequence, how many) by room left."""
        open_: dict[int, list[tuple[int, int]]] = {}

        def put(s: int, first: int, seqs: int, per_seq: int, room: int) -> None:
            self._place(s, seqs * per_seq, first, per_seq, self.capacity - room)
            if room > s * per_seq:
                open_.setdefault(room - s * per_seq, []).append((first, seqs))

        for s in sorted(self.left, reverse=True):
            for room in sorted(r for r in open_ if r >= s):
                per_seq = room // s
                groups, open_[room] = open_[room], []
                for first, seqs in groups:
                    n = self.left.get(s, 0)
                    full = min(seqs, n // per_seq)
                    if full:
                        put(s, first, full, per_seq, room)
                        n -= full * per_seq
                    rest = seqs - full
                    if rest and n:
                        put(s, first + full, 1, n, room)
                        full, rest = full + 1, rest - 1
                    if rest:
                        open_[room].append((first + full, rest))
                if not open_[room]:
                    del open_[room]
            n, per_seq = self.left.get(s, 0), self.capacity // s
            if n >= per_seq:
                put(s, self.sequences, n // per_seq, per_seq, self.capacity)
                self.sequences += n // per_seq
            if n % per_seq:
                put(s, self.sequences, 1, n % per_seq, self.capacity)
                self.sequences += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    made = Plan(capacity, counts)
    made.reduce()
    made.best_fit()
    return made


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", remembered: int = GENERATION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than capacity are cut, the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    wide = np.concatenate([ids.astype("<u4"), end])
                    first = len(wide) % capacity or capacity
                    stops = range(first, len(wide) + 1, capacity)
                    for k, stop in enumerate(stops):
                        start = stop - capacity if k else 0
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(wide[start:stop].tobytes())))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if remembered < GENERATION:
            enc.forget()  # where a worker has little memory, it keeps nothing between tasks
            give_back()

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to rows with a length in 1 .. capacity."""
    spark = items.sparkSession
    numbered = global_positions(items, ["length", *order], "pack-order")
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    firsts = [(n, sum(c for m, c in counts.items() if m < n)) for n in sorted(counts)]
    starts = spark.createDataFrame(firsts, "length long, _first long")
    rules = [(r.length, r.lo, r.hi, r.first_seq, r.per_seq, r.offset) for r in plan(counts, capacity).rules]
    # Some rules for each length that exists, however many rows there are.
    table = spark.createDataFrame(rules, "length long, lo long, hi long, first_seq long, per_seq long, base long")
    ranked = numbered.join(F.broadcast(starts), "length").withColumn("_rank", F.col("_pos") - F.col("_first"))
    at = F.col("_rank") - F.col("lo")
    hit = ranked.join(F.broadcast(table), "length").where((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return hit.select(
        *items.columns,
        (F.col("first_seq") + F.floor(at / F.col("per_seq"))).cast("long").alias("sequence_id"),
        (F.col("base") + (at % F.col("per_seq")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, remembered: int = GENERATION) -> DataFrame:
    """remembered bounds a worker's memory of encoded words; results do not depend on it."""
    return pack(stage(pieces(docs, tokenizer, end_id, capacity, remembered=remembered), "pack-pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
