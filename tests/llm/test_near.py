import random
import re

import pytest

from lithoscope.llm import linking, near_dedup


def brute(texts, threshold=75):
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 200))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append((n * 7 % 1009, rng.choice([" ", "\n", "  "]).join(words)))
            n += 1
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(12):  # each is like the next only
        texts.append((2000 + k, " ".join(chain[k * 5 : k * 5 + 5] + chain[: k * 5] + [f"x{j}" for j in range(k, k + 60)])))
    return texts + [(3000, None), (3001, ""), (3002, " \n"), (3003, "One two"), (3004, "one TWO"), (3005, "one two three"), (3006, "Éa b c d e"), (3007, "éa b c d e"), (3008, "same words here now ok " * 3000)]


def test_near_dedup_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in texts], "doc_id long, text string, node int, component string").repartition(4)
    want = brute(texts)
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(texts)


def test_near_dedup_of_few_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_dedup(none).count() == 0
    twice = spark.createDataFrame([(4, "a b c"), (4, "a b c"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(twice).collect()) == [(4, 4, True), (4, 4, True), (5, 5, True)]


def test_one_verdict_for_each_document(spark):
    rows = [(1, "a b c d e f g"), (2, "p q r s t u v"), (2, "a b c d e f g"), (2, None), (3, "P q R s t u v"), (4, None), (4, "x y"), (None, "x y")]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 4, False), (1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_a_crowd_of_altered_copies(spark):
    """Hundreds of copies of one text, altered so much that most are alike to the original at most, some to each other only."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    texts = [(0, " ".join(base))]
    for i in range(1, 260):
        words = list(base) if i % 9 else base[: 80 - i % 2]
        for j in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{i // 3 if i % 5 == 0 else i}_{j}"
        texts.append((i, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = brute(texts)
    assert len({c for _, c in want.values()}) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(40)], [(5, 4), (4, 3), (9, 9), (8, 7), (3, 1), (7, 1)]])
def test_components(spark, edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = linking.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == root


def test_estimate(spark):
    import numpy as np

    hasher, rng = near_dedup.MinHash(), np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9):
        common = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * (1 - share) / (1 + share)) if share else 2000
        a, b = (np.concatenate([common if share else common[:0], rng.integers(0, 2**63, n, dtype=np.uint64)]) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        row = [(([*hasher.packed(hasher.minima(a)).view(np.int64).tolist()],), ([*hasher.packed(hasher.minima(b)).view(np.int64).tolist()],))]
        got = spark.createDataFrame(row, "x struct<packed: array<long>>, y struct<packed: array<long>>").select(near_dedup.estimate("x", "y").alias("e")).first().e
        assert abs(got - true) < 0.17, (got, true)
