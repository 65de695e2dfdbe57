import zlib

import cases
import pytest
from oracle import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from storyloom.llm.sharding import OP6_SQL, jump_shard, op6_sharding, shard_rows


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 9, 100])
def test_jump_hash(spark, n):
    keys = [*range(-5, 60), 2**63 - 1, -(2**63), 1234567890123]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_shard(F.col("k"), n).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: jump(k, n) for k in keys}


def test_rows(spark):
    got = shard_rows(cases.awkward(cases.docs(spark)), shards=8).collect()
    given = cases.rows()
    assert len(got) == len(given)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in given)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert all(r.shard == jump(-1 if r.doc_id is None else r.doc_id, 8) for r in got)
    assert shard_rows(cases.none(spark)).count() == 0


def test_oracle(spark):
    assert spark_rows(op6_sharding(spark, SMALL)) == duck_rows(SMALL, OP6_SQL)
