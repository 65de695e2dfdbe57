"""Language mixtures and toxic spans: held-out accuracy and defined results."""

import random

import cases
import numpy as np

from storyloom.llm import language as lg
from storyloom.llm import toxicity as tx
from storyloom.llm._common import held_out


def test_language(spark):
    df = cases.awkward(cases.docs(spark))
    model = lg.train(df, ~held_out("doc_id"))
    got = {r.doc_id: r for r in lg.identify(df.drop("score", "mixture"), model).collect()}
    for d in (1, 2, 7, 8):
        assert got[d].lang_pred == "und" and got[d]["score"] == 0.0
    right = [got[100 + i].lang_pred == ("en", "fr", "de")[i % 3] for i in range(30)]
    assert sum(right) >= 28
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert lg.identify(cases.none(spark), model).count() == 0
    blank = lg.train(cases.none(spark), ~held_out("doc_id"))
    assert {r.lang_pred for r in lg.identify(cases.docs(spark), blank).collect()} == {"und"}


def test_mixtures(spark):
    model = lg.train(cases.docs(spark), ~held_out("doc_id"))
    mix = model.mixture(cases.words(300, 901, 1) + " " + cases.words(100, 902, 2))
    share = dict(zip(model.languages, mix, strict=True))
    assert share["fr"] > share["de"] > 0.1 and share["en"] < 0.05
    assert np.count_nonzero(model.mixture(cases.words(200, 903, 0))) == 1


def toxic_corpus(spark, n=240):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        body = cases.words(40, 1000 + i).split()
        if i % 4 == 0:
            for _ in range(2):
                body.insert(rng.randrange(len(body)), rng.choice(["loser", "moron", "vileish", "vileous", "vileful"]))
        rows.append((i, " ".join(body), "en", "a", 0))
        labels.append((i, 0, int(i % 4 == 0)))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = tx.train(docs, labels.unionByName(spark.createDataFrame([(1, 0, None), (None, 0, 1), (9999, 0, 1)], labels.schema)), ~held_out("doc_id"))
    got = {r.doc_id: r for r in tx.score_documents(docs, model).where(held_out("doc_id")).collect()}
    assert sum((got[d]["score"] >= tx.THRESHOLD) == (d % 4 == 0) for d in got) >= 0.95 * len(got)
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = {texts[d][s["start"] : s["end"]] for d, r in got.items() if d % 4 == 0 for s in r.spans}
    assert {"loser", "moron"} <= spans
    edge = tx.score_documents(cases.awkward(cases.docs(spark)).drop("score", "spans"), model).collect()
    assert len(edge) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in edge)
    assert [r["score"] < tx.THRESHOLD for r in edge if r.doc_id in (1, 2)] == [True, True]
    assert tx.score_documents(cases.none(spark), model).count() == 0
    untaught = tx.train(docs, labels.where("toxic = 0"), ~held_out("doc_id"))
    assert max(r["score"] for r in tx.score_documents(docs, untaught).collect()) < 1e-6


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    moves = (0.7, -0.4, 0.3)  # stay toxic, enter, leave
    sequences = [rng.normal(size=n) for n in (1, 5, 3, 0)]
    for e, f, b in zip(sequences, *tx.chain(sequences, moves), strict=True):
        n = len(e)
        mass = np.zeros((n, 2))
        for code in range(2**n):
            y = [code >> t & 1 for t in range(n)]
            w = np.exp(sum(e[t] * y[t] for t in range(n)) + sum({(1, 1): moves[0], (0, 1): moves[1], (1, 0): moves[2], (0, 0): 0.0}[y[t], y[t + 1]] for t in range(n - 1)))
            for t in range(n):
                mass[t, y[t]] += w
        if n:
            assert np.allclose(e + f + b, np.log(mass[:, 1] / mass[:, 0]))
