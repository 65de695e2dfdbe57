"""Token-id files: one concatenated id array with Elias-Fano coded document boundaries (Vigna, 2013).

A block file holds the ids of consecutive documents, their ids (doc_id) and the ends of their runs. Both sorted sequences are
Elias-Fano coded: about 2 + log2(universe / n) bits an entry, with a sampled select directory over the upper bits, so no
table of 64-bit offsets exists. Files are written and read by Spark (text writer with one record a file; binaryFile
reader), so they live on any file system that Spark reaches and an attempt that dies leaves none behind.

The text writer passes the bytes of a string on unchanged, whatever they encode; tests hold that for Spark 4.1 by round trips.

Defined results: a null text is an empty one, so its document has the end id alone; very long texts are encoded whole; null doc_ids come first, and are kept;
repeated doc_ids are written one after another, in the order of their texts; an empty table gives no file and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm._common import new_path, range_bounds, range_bucket, read, running_offsets, shuffle_partitions, stage
from storyloom.llm._encode import encoder, vocabulary

SAMPLE = 64
#: Bytes of ids after which a block is closed; a longer document has a block of its own. Files are large, so that few are listed.
BLOCK_BYTES = 64 << 20

_EF = struct.Struct("<QQBII")  # entries, universe, low bits, bytes of upper bits, samples
_HEAD = struct.Struct("<4sBBIIIIqQIII")
_MAGIC, _VERSION = b"EFTI", 1


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def tobytes(self) -> bytes:
        head = _EF.pack(self.n, self.universe, self.low_bits, len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, data: memoryview) -> EliasFano:
        n, universe, low_bits, high_len, samples = _EF.unpack_from(data)
        low_len, at = (n * low_bits + 7) // 8, _EF.size
        low = np.frombuffer(data, np.uint8, low_len, at)
        high = np.frombuffer(data, np.uint8, high_len, at + low_len)
        return cls(n, universe, low_bits, low, high, np.frombuffer(data, "<u4", samples, at + low_len + high_len))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        word = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Entry i, from the nearest sample on: no other entry is decoded."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, -(int(self.high[at // 8]) & ((1 << (at % 8)) - 1)).bit_count()
        while seen + int(self.high[byte]).bit_count() <= left:
            seen += int(self.high[byte]).bit_count()
            byte += 1
        ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        place = byte * 8 + int(ones[left - seen])
        return ((place - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        weights = np.left_shift(np.uint64(1), np.arange(self.low_bits, dtype=np.uint64))
        return (high | (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)).astype(np.int64)


def pack_block(part: int, block: int, doc_ids: list[int | None], lengths: list[int], ids: bytes | bytearray, width: int) -> bytes:
    """One file: header, doc_ids, boundaries, ids. Its last byte is the line feed that the writer adds."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    keys = EliasFano.encode((known - first).astype(np.uint64)).tobytes()
    bounds = EliasFano.encode(np.cumsum(np.array(lengths, dtype=np.int64))).tobytes()
    crc = zlib.crc32(ids, zlib.crc32(keys + bounds))
    return b"".join([_HEAD.pack(_MAGIC, _VERSION, width, part, block, len(doc_ids), nulls, first, len(ids) // width, len(keys), len(bounds), crc), keys, bounds, ids])


class Block:
    """A block file read back: random access to documents by their place in it."""

    def __init__(self, data: bytes | pa.Buffer):
        magic, version, self.width, self.part, self.block, self.n_docs, self.nulls, self.first, self.n_ids, keys, bounds, crc = _HEAD.unpack_from(data)
        body = memoryview(data)[_HEAD.size : _HEAD.size + keys + bounds + self.n_ids * self.width]
        if magic != _MAGIC or version != _VERSION or zlib.crc32(body) != crc:
            raise ValueError("not an intact id block")
        self.keys, self.bounds = EliasFano.frombytes(body[:keys]), EliasFano.frombytes(body[keys : keys + bounds])
        self.ids = np.frombuffer(body, f"<u{self.width}", self.n_ids, keys + bounds)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all() + self.first).tolist()

    def span(self, i: int) -> tuple[int, int]:
        """First and past-the-last id of document i; no other boundary is decoded."""
        return self.bounds.select(i - 1) if i else 0, self.bounds.select(i)

    def document(self, i: int) -> np.ndarray:
        first, past = self.span(i)
        return self.ids[first:past]


def write_id_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the block files under path, in ascending key order.

    One shuffle carries the texts: cut points of the key come from a sketch of the key column, so texts are neither sampled
    nor sorted globally. A partition is a range of keys and writes its blocks one after another.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bounds = range_bounds(docs, key, parts)
    ranged = range_bucket(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", bounds, "part")
    ordered = ranged.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        width = enc.dtype().itemsize
        keys: list[int | None] = []
        lengths: list[int] = []
        held = bytearray()
        made = part = 0

        def close() -> pa.RecordBatch:
            data = pack_block(part, made, keys, lengths, held, width)
            held.clear()
            ends = pa.py_buffer(np.array([0, len(data)], np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(data)])], ["payload"])  # without a copy

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                piece = batch.slice(start, 1024)
                if piece.num_rows:
                    part = piece.column("part")[0].as_py()
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), enc.encode(piece.column("text").to_pylist()), strict=True):
                    if held and len(held) + ids.nbytes > BLOCK_BYTES:
                        yield close()
                        keys, lengths, made = [], [], made + 1
                    keys.append(doc_id)
                    lengths.append(len(ids) + 1)
                    held += ids.tobytes()
                    held += end
        if keys:
            yield close()

    # The text writer puts the bytes of each record and a line feed into a file; with one record a file that is the format.
    made = ordered.mapInArrow(blocks, "payload binary").select(F.col("payload").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_id_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, place, doc_id, start, n_tokens, ids_crc32) of each document; start is its first id over all files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                block = Block(content.as_buffer())
                doc_ids = block.doc_ids()
                for at in range(0, block.n_docs, 10_000):
                    places = range(at, min(at + 10_000, block.n_docs))
                    spans = [block.span(i) for i in places]
                    crcs = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in spans]
                    n = len(places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block.part] * n, pa.int32()), pa.array([block.block] * n, pa.int32()), pa.array(places, pa.int32()), pa.array(doc_ids[at : at + n], pa.int64()),
                            pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crcs, pa.int64()),
                        ],
                        ["part", "block", "place", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    found = stage(files.mapInArrow(documents, "part int, block int, place int, doc_id long, local long, n_tokens long, ids_crc32 long"), "id-boundaries")
    by_block = found.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_part = by_block.select("part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("in_part"))
    parts = running_offsets(by_block.groupBy("part").agg(F.sum("n").alias("n")), "part", "n", "before_part")
    starts = in_part.join(F.broadcast(parts), "part")
    return found.join(starts, ["part", "block"]).select(
        "part", "block", "place", "doc_id", (F.col("before_part") + F.col("in_part") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def op9_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "id-blocks")
    docs = read(spark, sf_dir, "documents")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_id_blocks(docs, path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_id_blocks(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
