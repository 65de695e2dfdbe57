"""Sharding by jump consistent hashing (Lamping and Veach, 2014): keys to shards without a ring table.

A row's shard depends on its key and the number of shards alone. Going from n to n + 1 shards moves a row only into the
new shard, and moves 1/(n + 1) of all rows. Only DataFrame functions are used.

Defined results: a null key hashes as -1; a null text has no bytes (size 1, crc32 0); repeated rows get the same shard and
slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm._common import global_positions, read, running_offsets, stage

# Fixed values of the published algorithm: the multiplier of its linear congruential generator, and 2^31.
MULTIPLIER = 2862933555777941757
TWO_31 = 2147483648.0

_LOW = 0xFFFFFFFF
#: Steps within which nearly every key has its shard; the few others take the long way, with one step for each shard.
_USUAL_STEPS = 48


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2^64 on 32-bit halves: no product passes 2^49, so ANSI arithmetic cannot overflow."""
    c_lo, c_hi = MULTIPLIER & _LOW, MULTIPLIER >> 32

    def times(x: Column, c: int) -> tuple[Column, Column]:
        return x * F.lit(c & 0xFFFF), x * F.lit(c >> 16)

    p0, p1 = times(lo, c_lo)
    low_sum = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(low_sum, 32) + F.shiftright(p1, 16)

    def low_product(x: Column, c: int) -> Column:
        a, b = times(x, c)
        return a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)

    new_hi = (carry + low_product(hi, c_lo) + low_product(lo, c_hi)).bitwiseAND(_LOW)
    return new_hi, low_sum.bitwiseAND(_LOW)


def _steps(key: Column, shards: int, steps: int) -> Column:
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def jump(acc: Column, _: Column) -> Column:
        hi, lo = _advance(acc["hi"], acc["lo"])
        nxt = F.floor((acc["j"] + 1).cast("double") * (F.lit(TWO_31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), acc["j"].alias("b"), nxt.alias("j"))
        return F.when(acc["j"] < shards, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a 64-bit integer key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    if shards <= _USUAL_STEPS:
        return _steps(key, shards, shards)["b"].cast("int")
    usual = _steps(key, shards, _USUAL_STEPS)
    return F.when(usual["j"] >= shards, usual["b"]).otherwise(_steps(key, shards, shards)["b"]).cast("int")


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row.

    slot numbers a shard's rows from 0 in key order. The texts are measured where they are read; only the narrow rows are
    ordered, by one range shuffle over (shard, key), and a shard's first position turns a global one into a slot.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    # Written first: finding the ranges would read and measure the texts once more.
    narrow = stage(measured, "shard-rows")
    placed = global_positions(narrow, ["shard", key, "text_crc32", "size"], "shard-slots")
    starts = running_offsets(placed.groupBy("shard").agg(F.count("*").alias("_n")), "shard", "_n", "_start")
    return placed.join(F.broadcast(starts), "shard").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_pos") - F.col("_start")).alias("slot"), "grown_shard"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), shards=8)


OP6_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS c
    FROM range(256) r(i))
),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (
  SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes
  FROM d
),
c AS (
  SELECT doc_id, size,
         xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32
  FROM h, tab
),
ids AS (SELECT DISTINCT doc_id FROM d),
jump(doc_id, n, key, b, j) AS (
  SELECT doc_id, n::BIGINT, CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END::UHUGEINT, 0::BIGINT, 0::BIGINT
  FROM ids, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, k, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k // 8589934592::UHUGEINT) + 1::UHUGEINT)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, n, j, (key * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k FROM jump WHERE j < n)
),
s AS (SELECT doc_id, n, b::INTEGER AS shard FROM jump WHERE j >= n)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, a.shard AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY c.doc_id NULLS FIRST, c.text_crc32, c.size) - 1 AS slot, g.shard AS grown_shard
FROM c JOIN s a ON a.n = 8 AND a.doc_id IS NOT DISTINCT FROM c.doc_id JOIN s g ON g.n = 9 AND g.doc_id IS NOT DISTINCT FROM c.doc_id
"""
