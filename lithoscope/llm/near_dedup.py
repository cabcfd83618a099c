"""MinHash near-dedup with b-bit signatures.

A document's set holds its distinct shingles of WORDS words, hashed to 64 bits. MinHash keeps HASHES minima; bands of
ROWS whole minima make the candidates, and of each minimum the low BITS bits are packed into the signature. A candidate
pair's similarity is estimated from the number of equal low bits, corrected for chance collisions; pairs whose
estimate is more than SLACK below the threshold go no further (five standard deviations), the others are confirmed on
full sets. A pair at the threshold itself misses all bands with probability (1 - 0.75^4)^32 = 5e-6.

Documents with the same set are one node, so copies are never paired.

Cases: null counts as empty. A document without words is linked with nothing; with fewer than WORDS words its whole
sequence is its one shingle. Rows that share a doc_id are one document with all their texts, and get one verdict. Long texts are hashed in blocks. Other columns
play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import Table, attach, marked, small, text_of
from lithoscope.llm.linking import connected_components, link_buckets

WORDS, HASHES, ROWS, BITS = 5, 128, 4, 4
THRESHOLD, SLACK = 0.75, 0.2
#: ASCII lower case, and every white space of the contract as a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(text: str, k: int = WORDS) -> np.ndarray:
    """The document's set: distinct hashes in ascending order."""
    words = text.encode().translate(PLAIN).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(k, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for j in range(k):
            s = mixed(s * MIX + h[j : len(h) - k + 1 + j])
    return np.unique(s)


class MinHash:
    def __init__(self, hashes: int = HASHES, rows: int = ROWS, bits: int = BITS):
        rng = np.random.default_rng(20_240_229)
        self.a = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, hashes, dtype=np.uint64)
        self.hashes, self.rows, self.bits = hashes, rows, bits

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(self.hashes, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 2048):
                low = np.minimum(low, (self.a[:, None] * s[None, at : at + 2048] + self.b[:, None]).min(axis=1))
        return mixed(low)

    def bands(self, low: np.ndarray) -> np.ndarray:
        part = low.reshape(-1, self.rows)
        with np.errstate(over="ignore"):
            key = np.arange(len(part), dtype=np.uint64)
            for j in range(self.rows):
                key = mixed(key * MIX + part[:, j])
        return key

    def packed(self, low: np.ndarray) -> np.ndarray:
        """The low bits of all minima, in 64-bit words."""
        each = 64 // self.bits
        v = (low & np.uint64(2**self.bits - 1)).reshape(-1, each)
        return np.bitwise_or.reduce(v << (np.arange(each, dtype=np.uint64) * np.uint64(self.bits)), axis=1)


def signatures(docs: DataFrame, hashes: int = HASHES, rows: int = ROWS, bits: int = BITS, k: int = WORDS) -> DataFrame:
    """docs (doc_id, row_hash, text) -> doc_id, row_hash, n_shingles, two fingerprints of the set, bands, packed signature."""
    schema = "doc_id long, row_hash long, n_shingles long, f1 long, f2 long, bands array<long>, packed array<long>"

    def run(batches):
        import pyarrow as pa

        hasher = MinHash(hashes, rows, bits)
        for batch in small(batches, 512):
            out = []
            for doc_id, row_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(text.as_py(), k)
                if not len(s):
                    out.append((doc_id, row_hash, 0, 0, 0, None, None))
                    continue
                low = hasher.minima(s)
                with np.errstate(over="ignore"):
                    prints = np.array([s.sum(dtype=np.uint64), mixed(s ^ MIX).sum(dtype=np.uint64)]).view(np.int64)
                out.append((doc_id, row_hash, len(s), *prints.tolist(), hasher.bands(low).view(np.int64), hasher.packed(low).view(np.int64)))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2))], names=["doc_id", "row_hash", "n_shingles", "f1", "f2", "bands", "packed"])

    return docs.mapInArrow(run, schema)


def estimate(x: str, y: str, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from two packed signatures: the share of equal minima, less what chance makes equal."""
    lowest = sum(1 << (bits * i) for i in range(64 // bits))
    mask = F.lit(lowest - (1 << 64) if lowest >> 63 else lowest)
    unequal = F.lit(0)
    for i in range(hashes * bits // 64):
        d = F.col(f"{x}.packed")[i].bitwiseXOR(F.col(f"{y}.packed")[i])
        folded = d
        for j in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, j))
        unequal = unequal + F.bit_count(folded.bitwiseAND(mask))
    equal = 1 - unequal / hashes
    chance = 1 / 2**bits
    return (equal - chance) / (1 - chance)


def full_sets(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """texts (node, text) -> node, shingles."""

    def run(batches):
        import pyarrow as pa

        for part in small(batches, 512):
            sets = [shingles(t, k).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


class Sets:
    """Full sets of chosen nodes. firsts: (node, doc_id, row_hash), the row whose text stands for the node."""

    def __init__(self, plain: DataFrame, firsts: DataFrame, threshold: float, k: int):
        self.plain, self.firsts, self.percent, self.k = plain, firsts, round(100 * threshold), k

    def of(self, nodes: DataFrame) -> Table:
        rows = Table(self.firsts.join(nodes, "node", "left_semi"), "nodes").df
        # Only texts that may be wanted are shuffled; a merge join at every size, so that little is planned as much is.
        texts = marked(self.plain, rows, ["doc_id", "row_hash"]).filter("maybe").drop("maybe")
        chosen = attach(texts, rows.hint("merge"), ["doc_id", "row_hash"], "inner")
        return Table(full_sets(chosen.dropDuplicates(["node"]).select("node", "text"), self.k), "sets")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold. Only the pairs' own texts are read again."""
        sets = self.of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        with_b = attach(pairs, sets.df.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), ["b"], "inner")
        with_a = attach(with_b, sets.df.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), ["a"], "inner")
        both = F.size(F.array_intersect("sa", "sb"))
        return with_a.filter(100 * both >= self.percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    def across(self, rows: DataFrame) -> DataFrame:
        """rows (pivot, home, node, component) -> the pairs (a, b) under one pivot, of different components, that can be links.

        home is the pivot's component; of two components one isn't home, so one of the two nodes is an outsider.
        Alike sets X and Y have at least c = percent (|X| + |Y|) / (100 + percent) in common, of which at most what the
        pivot's set has of either is inside the pivot. So either X and Y meet in a shingle that the pivot hasn't, or the
        pivot has c of both; that bounds the other's size, which the join goes by then. A node alike to nothing but the
        crowd's own text meets nobody."""
        percent = self.percent
        sets = self.of(rows.select("node").unionAll(rows.select(F.col("pivot").alias("node"))).distinct())
        x = attach(rows, sets.df, ["node"], "inner")
        x = attach(x, sets.df.select(F.col("node").alias("pivot"), F.col("shingles").alias("ps")), ["pivot"], "inner")
        rest = F.array_except("shingles", "ps")
        n, inside = F.size("shingles"), F.size("shingles") - F.size(rest)
        x = Table(x.select("pivot", "home", "node", "component", n.alias("n"), rest.alias("rest"), inside.alias("inside")), "outside")
        sets.drop()
        need = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100).cast("int") - F.col("inside"))
        # Two that have `need` in common meet among all but need - 1 of either, in any one order.
        prefix = F.slice(F.sort_array("rest"), 1, F.greatest(F.lit(0), F.size("rest") - need + 1))
        spread = x.df.select("*", F.explode(prefix).alias("key"))
        met = spread.groupBy("pivot", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("pivot", "key")
        spread = Table(attach(spread, met, ["pivot", "key"], "inner"), "outside")
        size_class = lambda size: F.floor(F.log(size) / F.log(F.lit(1.1))).cast("long")
        least, most = F.ceil(percent * F.col("n") / 100), F.floor((100 + percent) * F.col("inside") / percent) - F.col("n")
        sized = x.df.withColumn("key", size_class(F.col("n")))
        reaching = x.df.filter(most >= least).withColumn("key", F.explode(F.sequence(size_class(least), size_class(most))))

        def pairs(outsiders: DataFrame, others: DataFrame) -> DataFrame:
            x = outsiders.filter("component <> home").select("pivot", "key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("inside").alias("ix"), F.col("rest").alias("rx"))
            y = others.select(F.col("pivot").alias("pivot_y"), F.col("key").alias("key_y"), F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("inside").alias("iy"), F.col("rest").alias("ry"))
            sizes = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
            # What they can have in common: all that the pivot has of the lesser, and what they share outside it.
            common = F.least("ix", "iy") + F.size(F.array_intersect("rx", "ry"))
            enough = (100 + percent) * common >= percent * (F.col("nx") + F.col("ny"))
            both = x.join(y, (F.col("pivot") == F.col("pivot_y")) & (F.col("key") == F.col("key_y")) & (F.col("cx") != F.col("cy")) & sizes & enough)
            return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

        return pairs(spread.df, spread.df).unionAll(pairs(reaching, sized))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, hashes: int = HASHES, rows: int = ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    text = text_of(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    signed = Table(signatures(plain, hashes, rows, bits, k).withColumn("node", F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "f1", "f2"))), "signatures")
    filled = signed.df.filter("node IS NOT NULL")
    # One row for each set: its first document's.
    first = filled.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))
    firsts = Table(first.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.row_hash").alias("row_hash")), "firsts").df
    same = (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("row_hash") == F.col("hash"))
    own = Table(filled.select("doc_id", "row_hash", "bands", "packed").join(firsts.select("node", F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")), same).dropDuplicates(["node"]).select("node", "bands", "packed"), "nodes")
    members = own.df.select(F.explode("bands").alias("bucket"), "node")
    sets = Sets(plain, firsts.filter("doc_id IS NOT NULL"), threshold, k)
    labels = link_buckets(members, own.df.select("node", "packed"), lambda x, y: estimate(x, y, hashes, bits) >= threshold - SLACK, sets.linked, sets.across)
    # Rows that share a doc_id are one document: its texts are linked.
    shared = filled.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    shared = Table(shared, "shared").df
    if not shared.isEmpty():
        texts = attach(filled.select("doc_id", F.col("node").alias("b")), shared, ["doc_id"], "inner").select("a", "b")
        labels = connected_components(texts.unionAll(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    named = Table(attach(signed.df.select("doc_id", "n_shingles", "node"), labels, ["node"]).select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component")), "named").df
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = attach(named, least, ["component"]).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if not shared.isEmpty():  # a document that has a text without words as well has its other texts' component
        whole = named.join(shared.select("doc_id"), "doc_id", "left_semi").join(least, "component").groupBy("doc_id").agg(F.min("component_id").alias("of_document"))
        out = out.join(whole, "doc_id", "left").withColumn("component_id", F.coalesce("of_document", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
