import random
import zlib

import numpy as np

from lithoscope.llm import toxicity as T


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    x, v = T.isotonic(raw, y, np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(v) > 0).all() and abs(np.average(np.interp(raw, x, v)) - y.mean()) < 0.05


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((T.Trees().fit(x, y).raw(x) > 0) == y).mean() > 0.95


def test_features_of_odd_texts():
    for t in ("", " ", "\n", "É" * 9, "!!??", "a" * 100_000, "you idiot", "Y0u 1d1ot id!ot", "😀"):
        x = T.features(t, {b"bad": 0.9, b"worse*": 0.5})
        assert len(x) == len(T.NAMES) and np.isfinite(x).all()
    assert T.features("you IDIOT", {})[0] == 0.5 and T.features("you IDIOT", {})[6] == 0.5
    assert T.features("worseness here", {b"worse*": 0.5})[1] == 0.5 and T.features("badly", {b"badl*": 0.7})[5] == 0.7


def test_held_out_accuracy(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["quxerly", "quxing", "idiot"]))
        rows.append((i, " ".join(words), 1, 0.5))
        labels.append((i, int(bad), 1))
    rows += [(5000, None, 1, 0.5), (5001, "", 1, 0.5), (0, rows[0][1], 1, 0.5)]
    labels += [(0, 1, 1), (9999, 1, 0), (7, None, 0), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double").repartition(4)
    truth = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = T.toxicity(docs, truth).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    held = got[got.held_out & (got.doc_id < 5000)]
    assert ((held.doc_id % 4 == 0) == (held.predicted == 1)).mean() > 0.95
    assert T.toxicity(docs.limit(0), truth).count() == 0
    assert set(T.toxicity(docs, truth.filter("toxic = 0")).toPandas().score) == {0.0}
    assert set(T.toxicity(docs, truth.limit(0)).toPandas().score) == {0.0}
