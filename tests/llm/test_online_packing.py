"""Online packing: levels against plain search, every id in one piece, no padding."""

import random
import zlib

import cases
import numpy as np
import pytest
from oracle import SMALL
from tokenizers import Tokenizer

from storyloom.llm._encode import vocabulary
from storyloom.llm.sum_of_squares import Levels, Packer, Piece, op11_online_packing, pack_online

BYTE = vocabulary("byte_bpe_50k.json")


def brute_choice(fills, size, capacity):
    """Try every level: the sum of squares after it, ties to the fullest."""

    def after(h):
        new = [f for f in fills]
        if h:
            new.remove(h)
        if h + size < capacity:
            new.append(h + size)
        return sum(new.count(f) ** 2 for f in set(new))

    return min((h for h in {0, *fills} if h + size <= capacity), key=lambda h: (after(h), -h))


@pytest.mark.parametrize("capacity", [2, 7, 16, 64])
def test_levels_against_brute_force(capacity):
    rng, levels, fills = random.Random(capacity), Levels(capacity), []
    for _ in range(600):
        size = rng.randint(1, capacity) if rng.random() < 0.5 else rng.choice([1, (capacity + 1) // 2, capacity])
        fill = levels.choose(size)
        assert fill == brute_choice(fills, size, capacity)
        levels.move(fill, size)
        if fill:
            fills.remove(fill)
        if fill + size < capacity:
            fills.append(fill + size)
        assert all(levels.counts[f] == fills.count(f) for f in range(1, capacity)) and not levels.counts[0] and not levels.counts[capacity]


@pytest.mark.parametrize("held", [1, 100, 1 << 20])
def test_windows_need_no_padding(held):
    rng, packer, got, given = random.Random(held), Packer(64, held), [], {}
    for key in range(500):
        ids = np.array([rng.randint(0, 99) for _ in range(rng.choice([1, 33, 40, rng.randint(1, 300)]))])
        given[key] = ids.tolist()
        got += packer.place(Piece(key, 0, len(ids), ids))
    got += packer.drain()
    assert all(w.fill == sum(len(p.ids) for p in w.pieces) and w.fill & (w.fill - 1) == 0 and w.fill <= 64 for w in got)
    back = {}
    for p in sorted((p for w in got for p in w.pieces), key=lambda p: p.start):
        assert p.start == len(back.setdefault(p.key, []))
        back[p.key] += p.ids.tolist()
    assert back == given
    if held > 100:
        assert sum(w.fill < 64 for w in got) <= 6  # only what is left at the end
        assert sum(len(w.pieces) for w in got) < 500 + sum(len(i) // 64 for i in given.values()) + 250


def check(rows, docs, capacity):
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    want = sorted((d if d is not None else -1, [*t.encode(text or "", add_special_tokens=False).ids, 1]) for d, text in docs)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
    counted = {}
    for key, ids in want:
        counted.setdefault(key, []).append(ids)
    assert set(counted) == set(by_doc)
    for key, copies in counted.items():
        assert sum(r.length for r in by_doc[key]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(by_doc[key], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(copies[0])
                assert r.ids_crc32 == zlib.crc32(np.array(copies[0][at : at + r.length], "<u4").tobytes())
                at += r.length


@pytest.mark.parametrize("capacity,held", [(2048, 16 << 20), (64, 500)])
def test_pieces(spark, capacity, held):
    got = pack_online(cases.awkward(cases.docs(spark)), BYTE, 1, capacity, held=held).collect()
    check(got, [r[:2] for r in cases.rows()], capacity)
    assert pack_online(cases.none(spark), BYTE, 1).count() == 0


def test_query(spark):
    got = op11_online_packing(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(got, [(r.doc_id, r.text) for r in docs], 2048)
    assert len({r.doc_id for r in got if r.length < r.doc_tokens <= 2048}) <= 0.2 * len(docs)  # few documents that fit are cut, even in so small a table
