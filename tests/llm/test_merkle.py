"""The manifest against a tree built in plain Python, and against its SQL."""

import hashlib
import zlib

import cases
import pytest
from oracle import SMALL, duck_rows, spark_rows
from pyspark.sql import functions as F

from storyloom.llm import merkle
from storyloom.llm.merkle import OP13_SQL, op13_merkle, proofs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hs):
    levels = [hs]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, h):
    proof = ""
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
        proof, h, at = proof + left + right, H(left, h, right), at // 8
    return proof, h


def brute(rows):
    """rows of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for d, text, lang, source, n in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        leaf, other = (H(*map(sized, (d, source, lang, n, t))) for t in (text, lower))
        third = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups.setdefault(b"" if lang is None else b"+" + lang.encode(), []).append((d is not None, d or 0, leaf, other if third else leaf))
    order = sorted(groups)
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for i, g in enumerate(order):
        for at, (known, d, leaf, other) in enumerate(sorted(groups[g])):
            proof, h = climb(trees[g], at, other)
            more, h = climb(top, i, h)
            out.append((d if known else None, leaf, trees[g][-1][0], root, H(proof, more), h, h == root))
    return out


COLUMNS = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


def result(spark, docs):
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in proofs(docs, tampered=F.when(third, F.translate("text", merkle.UPPER, merkle.LOWER))).collect())))


def test_awkward_rows(spark):
    got = result(spark, cases.awkward(cases.docs(spark)))
    assert got == sorted(map(str, brute(cases.rows())))
    assert result(spark, cases.none(spark)) == []


def test_deep_tree_many_groups_and_scattered_ids(spark):
    rows = [((i * 2_654_435_761) % (1 << 63) - (1 << 62), f"Text {i}", "en", "a", i) for i in range(1200)]
    rows += [(i, f"T{i}", f"l{i:02d}", None, None) for i in range(30)]  # groups of one, more of them than a run holds
    rows += [(None, "Same", "fr", "a", 4)] * 20 + [(7, "Same", "fr", "a", 4)] * 20 + [(-(1 << 63), "x", "fr", "a", 1), ((1 << 63) - 1, "y", "fr", None, 1), (None, None, None, None, None)]
    assert result(spark, spark.createDataFrame(rows, cases.SCHEMA).repartition(3)) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("n", [1, 8, 9, 513])
def test_every_height(spark, n):
    rows = [(i, f"A{i}", "en", "a", i) for i in range(n)]
    assert result(spark, spark.createDataFrame(rows, cases.SCHEMA)) == sorted(map(str, brute(rows)))


def test_oracle(spark):
    got = spark_rows(op13_merkle(spark, SMALL))
    assert got == duck_rows(SMALL, OP13_SQL)
    assert {r[-1] for r in got[1]} == {"True", "False"}
