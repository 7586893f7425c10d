"""Quality and toxicity: held-out accuracy, gradients, odd rows."""

import random
import zlib

import numpy as np

from ratewright.llm import quality, toxicity
from ratewright.llm.features import form_features, word_features

WORDS = "stone river market garden winter travel letter window morning copper silver engine museum harbour forest".split()


def texts(rng, n, poor=0.3, toxic=0.15):
    rows = []
    for i in range(n):
        w = rng.choices(WORDS, k=rng.randrange(20, 200))
        bad = rng.random() < toxic
        if bad:
            for _ in range(max(2, len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(["gruntling", "snarfish", "blorgod"])
        good = rng.random() >= poor
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x for x in w for _ in range(6)), " | ".join(w)])
        rows.append((i, text, int(good), int(bad)))
    return rows


def test_ordinal_fit_recovers_order_and_tails():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 3))
    z = x @ np.array([2.0, -1.0, 0.5])
    grade = (z + rng.logistic(size=3000) > -1).astype(int) + (z + rng.logistic(size=3000) * 0 > 2)
    row, feature = np.repeat(np.arange(3000), 3), np.tile(np.arange(3), 3000)
    model = quality.fit_ordinal(grade, row, feature, x.ravel(), dims=4, rounds=400)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.corrcoef(model.weights[:3], [2.0, -1.0, 0.5])[0, 1] > 0.98
    tails = model.tails(x @ model.weights[:3])
    assert (tails[:, 0] >= tails[:, 1]).all() and abs(tails[:, 0].mean() - (grade >= 1).mean()) < 0.02
    empty = quality.fit_ordinal(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
    assert np.isfinite(empty.thresholds).all()


def test_quality_on_held_out_texts(spark):
    rows = texts(random.Random(1), 900)
    odd = [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "word " * 40000), (5003, "word " * 40000), (None, "stone river market")]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + odd, "doc_id long, text string").selectExpr("*", "7 AS tails", "8 AS Expected_Grade", "9 AS keep")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows[:600]] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, quality.label_grades(labels))
    out = quality.graded(docs, model)
    assert out.columns == ["doc_id", "text", "keep", "expected_grade", "tails"]
    got = {r.doc_id: r for r in out.collect()}
    hits = [(got[i].tails[0] >= quality.KEEP) == bool(q) for i, _, q, _ in rows[600:]]
    assert np.mean(hits) > 0.97
    assert all(got[i].expected_grade == 0 and got[i].tails == [0.0, 0.0] for i in (5000, 5001, 5002))
    assert all(0 <= r.expected_grade <= 2 and r.tails[0] >= r.tails[1] for r in got.values())
    assert quality.graded(docs.limit(0), model).collect() == []
    none = quality.fit(docs, quality.label_grades(labels.limit(0)))
    assert len(quality.graded(docs, none).collect()) == len(rows) + len(odd)


def test_toxicity_on_held_out_texts(spark):
    rows = texts(random.Random(2), 1500, poor=0.0)
    odd = [(9000, None), (9001, ""), (9002, "snarfish " * 30000), (None, "stone"), (9003, "stone river"), (9003, "stone river")]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + odd, "doc_id long, text string").selectExpr("*", "0.5 AS score", "1 AS predicted")
    labels = spark.createDataFrame([(i, 1, x) for i, _, _, x in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    held = [(i, x) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200
    assert np.mean([got[i].predicted == x for i, x in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[9002].predicted == 1 and got[9000].score == got[9001].score
    assert toxicity.toxicity(docs.limit(0), model).collect() == []
    blank = toxicity.fit(docs, labels.limit(0))
    assert len(toxicity.toxicity(docs, blank).collect()) == len(rows) + len(odd)


def test_held_out_labels_are_never_learnt(spark):
    rows = texts(random.Random(3), 400, poor=0.0)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = [(i, x) for i, _, _, x in rows]
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, x in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_risk_goes_up_where_it_is_negative():
    # With few texts and many features of their own, the clean risk falls below zero; the fit stays finite and bounded.
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(40), 30)
    feature = rng.integers(0, 64, len(row))
    model = toxicity.fit_nnpu(np.arange(40) < 10, row, feature, prior=0.3, dims=64, rounds=400, least_texts=1)
    assert np.isfinite(model.weights).all() and np.abs(model.weights).max() < 20


def test_features_do_not_depend_on_neighbours():
    alone = [form_features([t], 1 << 12)[1].tolist() for t in (b"One two two", b"", b"three")]
    of, together = form_features([b"One two two", b"", b"three"], 1 << 12)
    assert [together[of == i].tolist() for i in range(3)] == alone
    of, f = word_features([b"Mixed CASE", b"mixed case"], 1 << 12)
    assert sorted(f[of == 0]) == sorted(f[of == 1])
