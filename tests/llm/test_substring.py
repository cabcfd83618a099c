import random
import re

from lithoscope.llm.substring_dedup import substring_dedup


def brute(rows, w):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in docs:
        for p in range(len(words) - w + 1 if i is not None else 0):
            k = tuple(words[p : p + w])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for p in range(len(words) - w + 1 if i is not None else 0):
            if first[tuple(words[p : p + w])] < i:
                gone.update(range(p, p + w))
        out.append((i, len(words), len(gone), " ".join(x for j, x in enumerate(words) if j not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([49, 50, 51, 70, 160]))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    copy = rows[3][1]
    rows += [(1000 + i, copy) for i in range(12)] + [(1100, copy + " end " + copy), (1101, copy.replace("w1", "v"))]
    rows += [(2000, "again " * 300), (2001, "again " * 120), (2002, None), (2003, ""), (2004, "w " * 49), (2005, "w " * 50), (2006, "w " * 51), (None, copy)]
    rows += [(2010, copy), (2010, copy), (2010, "é " * 60), (2011, "é " * 50 + "é")]
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in rows], "doc_id long, text string, first int, ranges string").repartition(4)
    got = substring_dedup(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 50)


def test_substring_dedup_of_no_rows(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    short = spark.createDataFrame([(1, "too short"), (2, "too short")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup(short).collect()] == [0, 0]
