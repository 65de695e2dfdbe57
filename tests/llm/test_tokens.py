"""Encoder, token counts, id files, packing: against the tokenizer itself."""

import random
import sys
import zlib

import cases
import numpy as np
import pytest
from tokenizers import Tokenizer

from storyloom.llm import packing
from storyloom.llm._encode import PieceEncoder, vocabulary
from storyloom.llm.binary_ids import Block, EliasFano, pack_block, read_id_blocks, write_id_blocks
from storyloom.llm.token_counts import allocate, count_field_tokens, count_line_tokens, line_starts

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def brute(path, text, end):
    return np.array([*plain(path).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_tokenizer(path):
    rng = random.Random(7)
    alphabet = ["a", "B", "é", "İ", "ß", "Σ", "٣", "9", ".", ",", "'s", "!", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\u00a0", "\u200b", "\u0301", "😀", "the", "ing", "—", "<|endoftext|>"]
    texts = ["", " ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(1500)), *[t for _, t, *_ in cases.rows() if t]]
    enc, t = PieceEncoder(path), plain(path)
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        got = [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in enc.offsets(texts)]
        assert got == [e.offsets for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memory_of_the_encoder_is_bounded(path):
    rng = random.Random(3)
    odd = [cases.words(400, 50 + i) + "\u200b" + cases.words(400, 90 + i) for i in range(40)]
    whole = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(rng.choice([30, 2000]))) for _ in range(150)]
    many = [" ".join(f"w{rng.getrandbits(60)}" for _ in range(300)) for _ in range(40)]
    texts = [*odd, *whole, *many]
    enc, t, most = PieceEncoder(path), plain(path), 300_000
    for memory in (enc.ids, enc.spaced, enc.spans):
        memory.most = most
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in enc.offsets(texts)] == [e.offsets for e in t.encode_batch(texts, add_special_tokens=False)]
    for memory in (enc.ids, enc.spaced, enc.spans):
        for held in (memory, memory.last):
            assert max(map(len, held), default=0) <= 64
            assert sum(sys.getsizeof(k) + sum(map(sys.getsizeof, v if isinstance(v, tuple) else [v])) for k, v in held.items()) <= most


def test_settings_are_read_and_not_searched_for():
    from storyloom.llm._encode import _kinds

    assert _kinds({"type": "Sequence", "normalizers": [{"type": "Replace", "content": "Lowercase"}]}) == {"Sequence", "Replace"}
    assert "Removed" not in _kinds({"type": "Split", "pattern": {"String": "Removed"}, "behavior": "Isolated"})


def test_allocation_rules():
    first, past, starts = np.array([0, 2, 4, 8]), np.array([2, 7, 8, 10]), np.array([0, 3, 5])
    assert allocate(first, past, starts, 10, "start")[0].tolist() == [2, 1, 1]
    assert allocate(first, past, starts, 10, "end")[0].tolist() == [1, 0, 3]
    assert allocate(first, past, starts, 10, "majority")[0].tolist() == [1, 1, 2]
    split, crossing = allocate(first, past, starts, 10, "split")
    assert split == pytest.approx([1.2, 0.65, 2.15]) and crossing.tolist() == [1, 2, 2]
    assert line_starts("a\nbé\n").tolist() == [0, 2] and line_starts("").tolist() == [0]


@pytest.mark.parametrize("rule", ["start", "end", "majority", "split"])
def test_counts_add_up(spark, rule):
    got = count_line_tokens(cases.awkward(cases.docs(spark).where("doc_id is null or doc_id <> 16")), BYTE, rule).toPandas()
    for d, text, *_ in cases.rows():
        if d is not None and d != 16:
            mine = got[got.doc_id == d].sort_values("section")
            assert mine.n_tokens.sum() == pytest.approx(len(brute(BYTE, text, 0)) - 1)
            assert "".join((text or "")[a:b] for a, b in zip(mine.char_start, mine.char_end, strict=True)) == (text or "")
    assert count_line_tokens(cases.none(spark), BYTE, rule).count() == 0


def test_fields(spark):
    df = spark.createDataFrame([(1, "ab cd", None, "ef\ngh")], "doc_id long, a string, b string, c string")
    got = count_field_tokens(df, ["a", "b", "c"], BYTE).orderBy("section").collect()
    assert [(r.field, r.char_start) for r in got] == [("a", 0), ("b", 6), ("c", 7)]
    assert sum(r.n_tokens for r in got) == len(brute(BYTE, "ab cd\n\nef\ngh", 0)) - 1


def test_elias_fano():
    rng = random.Random(3)
    for values in ([], [0], [5], [7] * 300, sorted(rng.randrange(10**9) for _ in range(1000)), sorted(rng.randrange(50) for _ in range(1000)), [0, 2**40]):
        back = EliasFano.frombytes(memoryview(EliasFano.encode(np.array(values, dtype=np.uint64)).tobytes()))
        assert back.all().tolist() == values
        assert [back.select(i) for i in range(len(values))] == values
    dense = EliasFano.encode(np.arange(0, 10**6, 100)).tobytes()
    assert len(dense) < 10**4 * 1.3  # about 8.7 bits and a sample each 64, against 8 bytes in a table


def test_block_round_trip():
    data = pack_block(3, 1, [None, -4, 7, 7], [2, 1, 3, 1], np.arange(7, dtype="<u2").tobytes(), 2)
    block = Block(data + b"\n")
    assert (block.part, block.block, block.doc_ids()) == (3, 1, [None, -4, 7, 7])
    assert [block.document(i).tolist() for i in range(4)] == [[0, 1], [2], [3, 4, 5], [6]]
    with pytest.raises(ValueError, match="intact"):
        Block(data[:-1] + b"\x09\n")


def test_id_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    write_id_blocks(cases.awkward(cases.docs(spark)), path, WORD, 1)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_id_blocks(spark, path).orderBy("start").collect()]
    want, at = [], 0
    for d, text, *_ in sorted(cases.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = brute(WORD, text, 1)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def check_plan(counts, capacity):
    plan = packing.plan(counts, capacity)
    fill, used = {}, {}
    for r in plan.rules:
        for k in range(r.lo, r.hi):
            seq, at = r.first_seq + (k - r.lo) // r.per_seq, r.offset + (k - r.lo) % r.per_seq * r.length
            fill.setdefault(seq, []).append((at, r.length))
            used.setdefault(r.length, []).append(k)
    assert {s: sorted(k) for s, k in used.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(fill) == list(range(plan.sequences))
    return plan


def best(items, capacity):
    """Fewest sequences, by trying all."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def place(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for b in {c: j for j, c in enumerate(bins) if c >= items[i]}.values():
            place(i + 1, [*bins[:b], bins[b] - items[i], *bins[b + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return found[0]


def test_plans_and_dominance():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = {s: items.count(s) for s in items}
        whole = best(items, capacity)
        reduced = packing.Plan(capacity, counts)
        reduced.reduce()
        rest = [s for s, n in reduced.left.items() for _ in range(n)]
        assert reduced.fixed + best(rest, capacity) == whole  # what dominance fixes costs no sequence
        assert whole <= check_plan(counts, capacity).sequences <= whole + 1
    assert packing.plan({1024: 10**9, 1000: 10**8, 24: 10**8, 3: 5}, 1024).sequences == 10**9 + 10**8 + 1
    check_plan({s: (s * 7919) % 1000 for s in range(1, 1025)}, 1024)
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def test_packed_documents(spark):
    got = packing.pack_documents(cases.awkward(cases.docs(spark)), BYTE, 2).collect()
    fill, pieces = {}, {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 1024
    for d, text, *_ in cases.rows():
        ids, mine = brute(BYTE, text, 2), sorted(set(pieces[d]))
        assert b"".join(ids[s : s + n].tobytes() for _, s, n, _ in mine) == ids.tobytes()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c and (n == 1024 or k == 0) for k, s, n, c in mine)
    assert len(pieces[16]) == 2 * len(set(pieces[16]))
    assert packing.pack_documents(cases.none(spark), BYTE, 2).count() == 0


def test_closing_marks_are_encoded_once():
    """Each distinct word with a mark cost a call of the whole tokenizer for the mark alone."""
    enc = PieceEncoder(vocabulary("byte_bpe_50k.json"))
    whole, calls = enc.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    enc.tokenizer = Counted()
    text = " ".join(f"{a}{b}x{m}" for a in "abcdeé" for b in "lmnop" for m in (",", ".", "?!")) + "\n a  b AB"
    texts = [text, "Word, word, Straße. ok", "x y"]
    assert [list(ids) for ids in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls.count(",") <= 1 and calls.count(".") <= 1 and calls.count("?!") <= 1
