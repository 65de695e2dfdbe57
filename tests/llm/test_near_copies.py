"""SimHash classes, components and fingerprints, against brute force."""

import hashlib
import random

import cases
import numpy as np
import xxhash
from pyspark.sql import functions as F

from storyloom.llm import fingerprints as fp
from storyloom.llm import simhash as sh
from storyloom.llm.components import connected_components


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201 + i) for i in range(50)] + [(7, 7)]
    want = roots(300, pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {n: want[n] for n in {x for p in pairs if p[0] != p[1] for x in p}}
    named = spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")
    assert {r.node: r.root for r in connected_components(named).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_connect_all_within_the_distance(spark):
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:  # chains and dense groups around some
        for _ in range(rng.choice([1, 3, 25])):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    values |= {0, 1, 3, 7, 15, 2**64 - 1}
    prints = np.array(sorted(values), dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[:i]) <= 3)]
    df = spark.createDataFrame([(i, bytearray(int(v).to_bytes(8, "big"))) for i, v in enumerate(prints)], "rep long, fp binary")
    for block in (4096, 3):  # the small block deals every bucket over several tasks
        found = [(r.a, r.b) for r in sh.links(df, sh.CONTRACT, block).distinct().collect()]
        assert all(np.bitwise_count(prints[a] ^ prints[b]) <= 3 for a, b in found)
        assert roots(len(prints), found) == roots(len(prints), pairs)


def test_classes_of_documents(spark):
    rows = cases.rows()
    got = sh.near_classes(cases.awkward(cases.docs(spark))).collect()
    assert len(got) == len(rows)
    known = [(d, t) for d, t, *_ in rows if d is not None]
    prints = {d: fingerprint(t) for d, t in known}
    keys = sorted(prints)
    pairs = [(i, j) for i in range(len(keys)) for j in range(i) if (prints[keys[i]] ^ prints[keys[j]]).bit_count() <= 3]
    want = {keys[i]: keys[r] for i, r in enumerate(roots(len(keys), pairs))}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert int.from_bytes(r.fp, "big") == prints[r.doc_id] and r.component_id == want[r.doc_id]
    assert sh.near_classes(cases.none(spark)).count() == 0


def likeness(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_one_of_each_near_class_stays(spark):
    rng, rows = random.Random(2), []
    for g in range(12):
        base = cases.words(300, 50 + g).split()
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 6):
            other = list(base)
            for _ in range(k):
                other[rng.randrange(len(other))] = cases.words(1, rng.random())
            rows.append((g * 10 + k, " ".join(other)))
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (0, rows[0][1])], "doc_id long, text string")
    kept = sorted(((r.doc_id is None, r.doc_id) for r in sh.drop_near_copies(df).collect()), key=str)
    texts = dict(rows)
    assert (True, None) in kept and len(kept) == len(set(kept))
    ids = [d for _, d in kept if d is not None]
    assert {d // 10 for d in ids} == set(range(12))  # every group keeps one
    missed = sum(any(likeness(texts[d], texts[e]) >= 0.8 for e in ids if e < d and e // 10 == d // 10) for d in ids)
    assert missed <= 2
    assert sh.drop_near_copies(cases.none(spark)).count() == 0


def variants(base, rng, g):
    """Copies of similarity 0.75 to 0.95, by kind of edit."""
    n = len(base)
    for share in (0.06, 0.1, 0.14):
        cut = max(1, int(n * share))
        fresh = cases.words(2 * cut, rng.random()).split()
        yield f"tail {share}", base[: n - cut // 2 - 1] + fresh[: cut // 2 + 1]
        yield f"appended {share}", base + fresh[:cut]
        yield f"cut off {share}", base[: n - cut]
        yield f"removed inside {share}", base[: n // 3] + base[n // 3 + cut :]
        at = rng.sample(range(n), max(1, int(cut / 5)))
        yield f"scattered {share}", [fresh[i % len(fresh)] if i in at else w for i, w in enumerate(base)]


def test_near_copies_of_each_kind_of_edit_are_found(spark):
    rng, rows, kinds = random.Random(9), [], {}
    for g, size in enumerate((80, 150, 400, 900)):
        base = cases.words(size, 700 + g).split()
        for kind, other in variants(base, rng, g):
            rows += [(len(rows), " ".join([w + str(len(rows)) for w in base])), (len(rows) + 1, " ".join([w + str(len(rows)) if w in base else w for w in other]))]
            kinds[len(rows) - 1] = (size, kind)
    texts = dict(rows)
    near = {d for d in kinds if likeness(texts[d], texts[d - 1]) >= 0.8}
    assert len(near) > 40
    kept = {r.doc_id for r in sh.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {kinds[d] for d in near & kept} == set() and kept == set(texts) - near


def test_classes_equal_brute_force_where_the_nearest_is_not_near_enough(spark):
    rng, rows = random.Random(3), []
    for g in range(6):
        family = [cases.words(120, 800 + g).split()]
        for k in range(30):  # each is an edit of some earlier one, so families are chains and stars about 0.8
            other = list(rng.choice(family))
            for _ in range(rng.randint(1, 4)):
                other[rng.randrange(len(other))] = cases.words(1, rng.random()) + "x"
            family.append(other)
        rows += [(g * 100 + i, " ".join(f)) for i, f in enumerate(family)]
    texts = [t for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] // 100 == rows[j][0] // 100 and likeness(texts[i], texts[j]) >= 0.8]
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(roots(len(rows), pairs))}
    assert len(set(want.values())) > 6
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4096, 3):
        assert {r.doc_id: r.component_id for r in sh.similar_classes(df, block=block).collect()} == want


def test_near_copies_in_awkward_documents(spark):
    df = cases.awkward(cases.docs(spark))
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {3, 16, 10, 11, None} <= set(ids) and not {5, 4, 9} & set(ids) and ids.count(16) == 1
    assert len({1, 2, 7} & set(ids)) == 1  # texts without a word are copies of one another


def test_fingerprints(spark):
    rows = cases.rows()
    got = fp.compare_with_edits(cases.awkward(cases.docs(spark))).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = {}
    for (d, t, *_), (_, u, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + u[:cut]
        want.setdefault(d, []).append((len(t), hashlib.sha256(changed.encode()).hexdigest(), likeness(t, changed) if t.split() else float(not changed.split()), likeness(t, u) if t.split() or u.split() else 1.0))
    for d in want:
        mine = sorted((r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got if r.doc_id == d)
        for a, b in zip(mine, sorted(want[d]), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 0.15 and abs(a[3] - b[3]) < 0.15
    assert len({r.fingerprint for r in got if r.doc_id in (3, 5)}) == 1
    assert fp.compare_with_edits(cases.none(spark)).count() == 0
    lone = fp.compare_with_edits(cases.docs(spark).where("doc_id = 10")).first()
    assert lone.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    a, b = cases.words(3000, 1), cases.words(3000, 2)
    one, two = fp.BottomK.of(a), fp.BottomK.of(b)
    both = one.merge(two)
    exact = len({*fp.shingle_hashes(a).tolist(), *fp.shingle_hashes(b).tolist()})
    assert abs(both.distinct() / exact - 1) < 0.2
    part = fp.BottomK.of(" ".join(a.split()[:1500]))
    assert part.containment(one) > 0.9 and abs(part.resemblance(one) - 0.5) < 0.1
    assert fp.BottomK.decode(one.encode()).values.tolist() == one.values.tolist()
    merged = fp.merge_sketches(fp.sketch_texts(cases.docs(spark)).join(cases.docs(spark).select("doc_id", "source"), "doc_id"), "source")
    assert {r.source for r in merged.collect()} == {"a", "b", None}


def test_texts_from_one_template_make_no_pairs(spark):
    """Each has three of the template's words changed: likeness about 0.7, nothing links, and no shared shingle makes a group."""
    rng, base, rows = random.Random(5), cases.words(100, 41).split(), []
    for d in range(300):
        text = list(base)
        for at in rng.sample(range(100), 3):
            text[at] = f"own{d}x{at}"
        rows.append((d, " ".join(text)))
    linked = {d for d, t in rows for e, u in rows if d != e and likeness(t, u) >= 0.8}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in sh.similar_classes(df).collect()}
    assert {d for d, c in classes.items() if d != c} <= linked
    distinct = sh._prefix_prints(df, 0.8).withColumn("rep", F.monotonically_increasing_id())
    apart = sh._apart(sh._prefix_rows(distinct).withColumn("root", F.col("rep")), sh.BLOCK, 0.8)
    pairs = sh._partners(apart, distinct.select("rep", "n", "bits"), 0.8, True)
    assert pairs.count() < 3 * len(rows)
