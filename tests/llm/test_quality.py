import math
import random
import re
from collections import Counter

import pytest
import xxhash

from lithoscope.llm import quality as Q


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = list(zip(w, w[1:], w[2:]))
    seen, covered = Counter(tri), set()
    for p, k in enumerate(tri):
        if seen[k] > 1:
            covered.update((p, p + 1, p + 2))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def grams(t, buckets):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed=seed)
    return [h(a) % 2**64 for a in w] + [h(b, h(a)) for a, b in zip(w, w[1:])]


def bucket(h, buckets):
    return (h - 2**64 if h >> 63 else h) % buckets


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou")
    out = {i: rng.choice([" ", "\n"]).join(word() for _ in range(rng.randint(0, 90))) for i in range(40)}
    out.update({100: None, 101: "", 102: " \n\t", 103: "one", 104: "a b c " * 60, 105: "x y\nx y\n\n \nx y", 106: "# $ %|<a>\t&*", 107: "a b a b a b a", 108: "é " * 70, 109: "z " * 3000 + "end"})
    return out


def test_equals_plain_version(spark, texts):
    rows = [(i, t, 3, "w") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, w string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 3)] + [(0,), (999,), (None,)], "doc_id long")
    buckets = 512
    got = {r.doc_id: r for r in Q.quality(docs, trusted, threshold=0.0, buckets=buckets).collect()}
    raw, aim = Counter(), Counter()
    for i, t in texts.items():
        g = [bucket(h, buckets) for h in grams(t, buckets)]
        raw.update(g)
        if i < 40 and i % 3 == 0:
            aim.update(g)
    ratio = sum(aim.values()) / sum(raw.values())
    llr = lambda b: math.log((aim[b] + Q.SMOOTHING) / (raw[b] * ratio + Q.SMOOTHING))
    for i, t in texts.items():
        r = got[i]
        n, *_ , repeated = want = measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        g = [bucket(h, buckets) for h in grams(t, buckets)]
        score = sum(map(llr, g)) / len(g) if g else None
        assert (r.score is None) if score is None else r.score == pytest.approx(score, abs=1e-9)
        assert r.kept == (not r.base_failed and (score or 0.0) >= 0.0)


def test_packed_hashes_that_clash(spark, monkeypatch):
    """Documents of more words than the packed form has places for take the exact way, with the same results."""
    from pyspark.sql import functions as F

    from lithoscope.llm.common import words_of

    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    monkeypatch.setattr(Q, "PLACE", 15)
    d = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", words_of(F.col("text")))
    got = Q.repeat_columns(d.withColumn("n", F.size("w"))).collect()
    assert [r.n_repeat_words for r in got] == [measures(r.text)[4] for r in got]


def test_without_trusted_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "w%d " % 1 + " ".join(f"u{i}" for i in range(60))), (1, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted(r.kept for r in Q.quality(docs, none).collect()) == [False, True]
    assert Q.quality(docs.limit(0), none).count() == 0
    assert [r.text for r in Q.keep_documents(docs, none).collect()] == [docs.first().text]
