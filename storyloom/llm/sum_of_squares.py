"""Online packing by sums of squares (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, 2006): windows filled as documents arrive.

A level array counts the partially filled windows at each fill. A piece goes to the level that makes the sum of the squared
counts smallest: an open window whose fill, once raised, is a rarer one than before, or a new window. Ties go to the fullest.
Documents above the capacity give full windows of their own and a rest, which is placed like any document.

Each task packs the documents that it reads, in their order, with a level array of its own; nothing is shuffled. At its end, or
once the ids held in open windows reach `held`, the open windows are drained: the emptiest ones are cut to fill the gaps of
the fullest. What is left, less than a window, is cut at powers of two. So no sequence needs padding, however a task's documents
are sized, and a task makes few sequences below the capacity: one for each bit of the tokens left in a drain.

Defined results: a null text is an empty one and gives its end id alone; very long texts are encoded whole; repeated rows are
packed one by one; null keys are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import read, slices
from storyloom.llm._encode import GENERATION, encoder, vocabulary

CAPACITY = 2048
#: Ids that a task holds in open windows before it drains them. Bounds memory; every drain leaves less than one window over.
HELD = 16 << 20


@dataclass
class Piece:
    key: int | None
    start: int
    total: int
    ids: np.ndarray

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.start, self.total, self.ids[:at]), Piece(self.key, self.start + at, self.total, self.ids[at:])


@dataclass
class Window:
    fill: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Levels:
    """How many open windows there are at each fill; fills 0 and `capacity` hold none."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)

    def choose(self, size: int) -> int:
        """The fill to raise by size; 0 opens a window. Moving a window from h to h + size changes the sum by 2 (N[h + size] - N[h] + 1)."""
        top = self.capacity - size
        here = self.counts[: top + 1]
        change = 2 * (self.counts[size:] - here + 1)
        change[0] -= 1  # nothing leaves level 0
        change[top] -= 1  # nothing stays at a full level
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return top - int(change[::-1].argmin())

    def move(self, fill: int, size: int) -> None:
        if fill:
            self.counts[fill] -= 1
        if fill + size < self.capacity:
            self.counts[fill + size] += 1


class Packer:
    """Yields finished windows as pieces come in."""

    def __init__(self, capacity: int = CAPACITY, held: int = HELD):
        self.levels, self.capacity, self.most, self.held = Levels(capacity), capacity, held, 0
        self.open: dict[int, list[Window]] = {}

    def place(self, piece: Piece) -> Iterator[Window]:
        while len(piece.ids) > self.capacity:
            full, piece = piece.cut(self.capacity)
            yield Window(self.capacity, [full])
        size = len(piece.ids)
        fill = self.levels.choose(size)
        window = self.open[fill].pop() if fill else Window()
        self.levels.move(fill, size)
        window.add(piece)
        self.held += size
        if window.fill == self.capacity:
            self.held -= self.capacity
            yield window
        else:
            self.open.setdefault(window.fill, []).append(window)
        if self.held >= self.most:
            yield from self.drain()

    def drain(self) -> Iterator[Window]:
        """Close all open windows: full ones by cutting the emptiest, and the rest at powers of two."""
        left = [w for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open, self.held = {}, 0
        self.levels.counts[:] = 0
        first, last = 0, len(left) - 1
        while first < last:
            taker, giver = left[first], left[last]
            gap, piece = self.capacity - taker.fill, giver.pieces.pop()
            if len(piece.ids) > gap:
                rest, piece = piece.cut(len(piece.ids) - gap)
                giver.pieces.append(rest)
            taker.add(piece)
            giver.fill -= len(piece.ids)
            if taker.fill == self.capacity:
                yield taker
                first += 1
            if not giver.fill:
                last -= 1
        if first == last:
            yield from _powers(left[first])


def _powers(window: Window) -> Iterator[Window]:
    pieces = window.pieces[::-1]
    left = window.fill
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        made = Window()
        while made.fill < room:
            piece = pieces.pop()
            if len(piece.ids) > room - made.fill:
                piece, rest = piece.cut(room - made.fill)
                pieces.append(rest)
            made.add(piece)
        yield made


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_online(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", held: int = HELD, remembered: int = GENERATION
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece. sequence_id counts within the task, above its number."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, remembered)
        end = np.array([end_id], dtype="<u4")
        packer, rows = Packer(capacity, held), []
        next_id = TaskContext.get().partitionId() << 33

        def note(windows: Iterator[Window]) -> None:
            nonlocal next_id
            for window in windows:
                offset = 0
                for p in window.pieces:
                    n = len(p.ids)
                    rows.append((p.key, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, next_id, offset))
                    offset += n
                next_id += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

        for part in slices(batches):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                note(packer.place(Piece(doc_id, 0, len(ids) + 1, np.concatenate([ids, end.astype(ids.dtype)]))))
                if len(rows) >= 4096:
                    yield batch()
        note(packer.drain())
        if rows:
            yield batch()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA)


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)
