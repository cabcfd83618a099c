"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The features are densities of a fixed and of a learned lexicon, closeness of lexicon words to the second person,
capitals, punctuation and obfuscation. The learned lexicon holds words and word beginnings. Fitting takes at most
SAMPLE labelled rows of each class, the ones with the smallest hashes; one half of them makes the lexicon, and the other
the trees (four fifths) and the calibration (one fifth). Calibration weighs the classes as all training rows have them.
Scoring is one pass over the texts with the model, whose size is bounded, in the closure.

Cases: null counts as empty; an empty text gets the score of its (zero) features. Labels that are null, or whose document
is missing, teach nothing; without both classes every score is the share of toxic rows (0 without any). Repeated labels
count once. Long texts are read whole, in one pass. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import Table, text_of

SAMPLE = 10_000
TERMS = 4_000
PREFIXES = (4, 5, 6, 8)
#: General insults in four languages. Fixed values.
LEXICON = """
idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb fool jerk creep
imbecile filth vermin garbage ugly
dumm dummkopf trottel arschloch abschaum widerlich wertlos versager
imbécile crétin connard abruti ordure débile minable salaud
estúpido imbécil basura escoria asqueroso patético inútil payaso
"""
#: The second person in four languages. Fixed values.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted tus"
#: What letters are replaced by. Fixed values.
LEET = str.maketrans("@403175$!", "aaoeltssi")
NAMES = ("fixed", "learned", "weight", "hits", "distinct", "strongest", "near_you", "you", "capitals", "marks", "symbols", "obfuscated", "hidden", "words")

#: ASCII lower case; ASCII punctuation and controls become spaces. Other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MIXED = re.compile(r"[^\W\d_]+[@$!*#\d]+[^\W\d_]+|[^\W\d_]*[@$][^\W_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
MARKS = re.compile(r"[!?]+")
SYMBOLS = re.compile(r"[#*$%&|<>@~^]+")
FIXED = frozenset(w.encode() for w in LEXICON.split())
YOU = frozenset(w.encode() for w in SECOND_PERSON.split())


def words_in(text: str) -> list[bytes]:
    return text.lower().encode().translate(PLAIN).split()


def terms_in(words: set[bytes]) -> set[bytes]:
    """The words, and their beginnings marked by a star."""
    out = set(words)
    for k in PREFIXES:
        out.update(w[:k] + b"*" for w in words if len(w) > k)
    return out


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    words = words_in(text)
    n = max(1, len(words))
    weight: dict[bytes, float] = {}
    for w in set(words):
        best = lexicon.get(w, 0.0)
        for k in PREFIXES:
            if len(w) > k and (x := lexicon.get(w[:k] + b"*", 0.0)) > best:
                best = x
        if w in FIXED or best:
            weight[w] = best
    fixed = learned = near = you = 0
    total = 0.0
    if weight or not YOU.isdisjoint(words):
        for i, w in enumerate(words):
            you += w in YOU
            if w in weight:
                fixed += w in FIXED
                learned += weight[w] > 0
                total += weight[w]
                near += not YOU.isdisjoint(words[max(0, i - 3) : i + 4])
    mixed = MIXED.findall(text)
    hidden = sum(1 for m in mixed if (x := m.lower().translate(LEET).encode()) in FIXED or x in lexicon)
    size = max(1, len(text))
    span = lambda p: sum(map(len, p.findall(text)))
    return [fixed / n, learned / n, total / n, math.log1p(max(fixed, learned)), float(len(weight)), max(weight.values(), default=0.0), near / n, you / n, span(UPPER) / size, span(MARKS) / size, span(SYMBOLS) / size, len(mixed) / n, hidden / n, math.log1p(len(words))]


class Trees:
    """Boosted regression trees on the logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree: list = []
            score += self.rate * self.grow(tree, b, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), dtype=np.int64)

    def grow(self, tree: list, b, g, h, rows, depth) -> np.ndarray:
        """Appends nodes (feature, bin, left, right) or (value,); returns every row's value (0 outside rows)."""
        out, node = np.zeros(len(g)), len(tree)
        tree.append((float(g[rows].sum() / (h[rows].sum() + 1.0)),))
        out[rows] = tree[node][0]
        best, all_g, all_h = (1e-6, -1, -1), g[rows].sum(), h[rows].sum()
        for j in range(b.shape[1] if depth and len(rows) >= 2 * self.least else 0):
            k = len(self.cuts[j]) + 1
            gs, hs, n = (np.bincount(b[rows, j], weights=w, minlength=k).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] >= 0:
            left = b[rows, best[1]] <= best[2]
            a = self.grow(tree, b, g, h, rows[left], depth - 1)
            at = len(tree)
            c = self.grow(tree, b, g, h, rows[~left], depth - 1)
            tree[node] = (best[1], best[2], node + 1, at)
            out = a + c
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, score = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            self.add(tree, 0, b, np.arange(len(x)), score)
        return score

    def add(self, tree, node, b, rows, score) -> None:
        if len(tree[node]) == 1:
            score[rows] += self.rate * tree[node][0]
        else:
            j, cut, left, right = tree[node]
            low = b[rows, j] <= cut
            self.add(tree, left, b, rows[low], score)
            self.add(tree, right, b, rows[~low], score)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; between the blocks' means the map is linear."""
    blocks: list[list[float]] = []
    for i in np.argsort(raw, kind="stable"):
        blocks.append([raw[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    w = np.array([b[2] for b in blocks])
    return np.array([b[0] for b in blocks]) / w, np.array([b[1] for b in blocks]) / w


class Model:
    def __init__(self, lexicon: dict[bytes, float], trees: Trees | None, steps: tuple | None, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, len(NAMES))
        return np.interp(self.trees.raw(x), *self.steps)


def learned_lexicon(sample: DataFrame, prior: float, least: int = 4) -> dict[bytes, float]:
    """The terms that tell toxic documents most surely: precision, smoothed, times two, less one."""

    def count(batches):
        import pyarrow as pa

        seen, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_in(set(words_in(text)))
                seen.update(terms)
                if label:
                    toxic.update(terms)
        terms = list(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([0] * len(terms), pa.int64())], names=["term", "toxic", "n"])
        rest = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.binary()), pa.array([0] * len(rest), pa.int64()), pa.array([seen[t] for t in rest], pa.int64())], names=["term", "toxic", "n"])

    counts = sample.select("text", "toxic").mapInArrow(count, "term binary, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    precision = (F.col("toxic") + 2 * prior) / (F.col("n") + 2)
    best = counts.filter((F.col("toxic") >= least) & (precision > 0.5 + prior / 2)).withColumn("p", precision)
    return {bytes(r.term): 2 * r.p - 1 for r in best.orderBy(F.desc("toxic"), "term").limit(TERMS).collect()}


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may teach: crc32 of the id as text, mod 5, isn't 0."""
    rows = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic."""
    train = training_rows(docs, labels)
    size = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    share = size.get(1, 0) / max(1, sum(size.values()))
    if len(size) < 2:
        return Model({}, None, None, share)
    order = F.xxhash64("doc_id")
    chosen = [train.filter(F.col("toxic") == k).orderBy(order).limit(sample) for k in (0, 1)]
    # At most 2 * sample rows of two numbers: that is the bound of what is broadcast here.
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))
    rows = docs.select("doc_id", text_of("text").alias("text")).join(ids, "doc_id").dropDuplicates(["doc_id"])
    table = Table(rows.select("doc_id", "text", "toxic", F.pmod(order, F.lit(10)).alias("part")), "toxicity")
    half = table.df.filter("part < 5")
    seen = {r.toxic: r["count"] for r in half.groupBy("toxic").count().collect()}
    lexicon = learned_lexicon(half.repartition(8), seen.get(1, 0) / max(1, sum(seen.values())))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "part"])

    got = table.df.filter("part >= 5").select("text", F.col("toxic").cast("int").alias("toxic"), "part", "doc_id").orderBy("doc_id").select("text", "toxic", "part").mapInArrow(measure, "x array<double>, toxic int, part long").toPandas()
    table.drop()
    x, y = np.array(got["x"].tolist()).reshape(-1, len(NAMES)), got["toxic"].to_numpy(dtype=float)
    grow = got["part"].to_numpy() < 9
    if len(set(y[grow])) < 2 or grow.all():
        return Model(lexicon, None, None, share)
    trees = Trees().fit(x[grow], y[grow])
    drawn = {k: max(1, int((got["toxic"] == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, size[1] / drawn[1], size[0] / drawn[0])
    return Model(lexicon, trees, isotonic(trees.raw(x[~grow]), y[~grow], weight[~grow]), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(model.scores(part.column(1).to_pylist()), 0.0, 1.0), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, "doc_id long, score double")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, sample))
