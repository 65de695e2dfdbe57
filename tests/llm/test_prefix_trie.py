"""The trie of conversation prefixes against a plain dictionary of prefixes, and against its SQL."""

import hashlib
import random
import zlib

import pytest
from oracle import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from storyloom.llm.prefix_trie import OP12_SQL, op12_prefix_trie, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return nodes(made)


def nodes(made):
    members = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(tuple(made[c][:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(made[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.select(*COLUMNS).collect())


def talk(convs, seed):
    """Few distinct turns, so that prefixes are shared; some nulls."""
    rng, rows = random.Random(seed), []
    for c in range(convs):
        turns = list(range(rng.choice([1, 3, 6, 12])))
        if rng.random() < 0.1:
            turns[0] = None
        rng.shuffle(turns)
        for t in turns:
            rows.append((c, t, rng.choice(["user", "user", None, ""]) if (t or 0) % 2 == 0 else "assistant", rng.choice(["Hé", "hello there", "", None, "x" * 3000])))
    return rows


@pytest.mark.parametrize("oversized,bucket", [(256, 2048), (3, 50)])
def test_against_brute_force(spark, oversized, bucket):
    rows = [*talk(40, 1), (None, 0, "user", "no conversation"), (100, 1, "user", "alone"), (-7, 0, None, None), (99, 5, "user", "far"), (99, 2, "user", "near")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gid", F.lit("clash")).withColumn("turns", F.lit(1)).repartition(3)
    assert result(trie(rebuilt(df), oversized, bucket)) == brute([r for r in rows if r[0] is None or r[0] >= 0 or r[0] == -7])


def test_hot_paths_are_divided(spark):
    """One first turn for all, a long shared beginning, many equal conversations, paths that end where others go on."""
    turn = lambda i: {"t": f"{i:032d}", "b": i}
    text = lambda i: ("", "b" * i)
    shapes = [list(range(1, 40))] * 30 + [[*range(1, 40), 50 + i] for i in range(20)] + [list(range(1, i)) for i in range(30, 50)] + [[1, 2, 3, 70 + i, 80 + i % 3] for i in range(30)] + [[5], [6, 7], []] * 2
    made = {c * 1000 - 3000: s for c, s in enumerate(shapes)}
    df = spark.createDataFrame([(c, [turn(i) for i in s]) for c, s in made.items()], "conv_id long, turns array<struct<t:string,b:bigint>>")
    want = nodes({c: [text(i) for i in s] for c, s in made.items()})
    for oversized in (12, 1000):
        assert result(trie(df.repartition(3), oversized, 64)) == want


def test_empty(spark):
    assert trie(rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    only = trie(spark.createDataFrame([(4, [])], "conv_id long, turns array<struct<t:string,b:bigint>>")).collect()
    assert [tuple(r)[:7] for r in only] == [(4, 0, None, 1, 0, 1, 0)] and only[0].ends_sha256 == hashlib.sha256(b"4").hexdigest()


def test_oracle(spark):
    assert spark_rows(op12_prefix_trie(spark, SMALL)) == duck_rows(SMALL, OP12_SQL)
