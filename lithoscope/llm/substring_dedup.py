"""Substring dedup over a log-structured fingerprint index.

Every window of WINDOW words is represented by the smallest hash of its GRAM-word grams, its anchor; equal windows
have equal anchors. Consecutive windows with one anchor are a stretch, about one for twenty words, with a 128-bit
fingerprint of all its words. The index holds sorted immutable runs of anchors with their smallest document. Each new
batch is merge-joined with the runs, which yields the anchors that several documents have, becomes a run itself, and
runs are compacted by merging when FANOUT of them have gathered.

Verification goes from coarse to fine over the shared anchors only: stretches whose fingerprint starts in a document
with a smaller id are covered whole; where stretches with one anchor differ, their windows are compared one by one by
128-bit hashes. Aggregates (smallest document of a key) go before every join, and joins let AQE split hot keys, so a
passage in a third of all documents is no pair of documents.

Cases: null text counts as empty. Rows that share a doc_id never cover each other; each row is judged by its own text.
Rows without a doc_id cover nothing and keep all. Words at a tie of anchors go by the leftmost gram. Long texts are
worked off in blocks. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.llm.common import Table, attach, text_of
from lithoscope.llm.near_dedup import mixed, word_hashes

WINDOW, GRAM, FANOUT, BATCHES = 50, 10, 3, 3
SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Odd multipliers of the two polynomial hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
SALTS = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
DOC = ["doc_id", "row_hash"]


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode().translate(SPACED).split(b" ") if w]


class Hashes:
    """Hashes of word ranges of one document, from running sums of word hash times base to the position."""

    def __init__(self, words: list[bytes]):
        h = word_hashes(words)
        self.n = len(h)
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base, salt in zip(BASES, SALTS):
                power = np.full(self.n + 1, base)
                power[0] = 1
                power = np.multiply.accumulate(power)
                inverse = np.full(self.n + 1, np.uint64(pow(int(base), -1, 2**64)))
                inverse[0] = 1
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(h ^ salt) * power[:-1])]))
                self.back.append(np.multiply.accumulate(inverse))

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the words start to stop (exclusive)."""
        with np.errstate(over="ignore"):
            return mixed((self.sums[which][stop] - self.sums[which][start]) * self.back[which][start] + (stop - start).astype(np.uint64))


def stretches_of(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """anchor, f1, f2, first and last window start of each stretch of a document."""
    if len(words) < window:
        return ()
    h = Hashes(words)
    starts = np.arange(h.n - gram + 1)
    grams = h.of(starts, starts + gram, 0)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.concatenate([view[i : i + 65_536].argmin(axis=1) for i in range(0, len(view), 65_536)]) + np.arange(len(view))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return grams[at[first]], h.of(first, last + window, 0), h.of(first, last + window, 1), first, last


def stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, row_hash, text) -> one row per stretch."""
    names = [*DOC, "anchor", "f1", "f2", "first", "last"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows, found = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    if got := stretches_of(words_of(text), window, gram):
                        found.append(got)
                        rows.append(np.full(len(got[0]), i))
                if found:
                    i = np.concatenate(rows)
                    a, f1, f2, s, e = (np.concatenate(x) for x in zip(*found))
                    columns = [ids[i], hashes[i], a.view(np.int64), f1.view(np.int64), f2.view(np.int64), s.astype(np.int32), e.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, row_hash long, anchor long, f1 long, f2 long, first int, last int")


class FingerprintIndex:
    """Sorted immutable runs of (anchor, smallest document) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.runs = spark, fanout, []

    def history(self) -> DataFrame:
        out = self.runs[0].df
        for run in self.runs[1:]:
            out = out.unionAll(run.df)
        return out

    def add(self, anchors: DataFrame) -> DataFrame:
        """Takes a batch of (anchor, doc_id); returns its anchors that two documents or more have so far."""
        own = Table(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).sortWithinPartitions("anchor"), "run")
        shared = own.df.filter("low < high").select("anchor")
        if self.runs:
            past = self.history().groupBy("anchor").agg(F.min("low").alias("past"))
            shared = own.df.join(past, "anchor", "left").filter("low < high OR past <> low OR past <> high").select("anchor")
        shared = Table(shared, "shared").df
        run = Table(own.df.select("anchor", "low").sortWithinPartitions("anchor"), "run")
        own.drop()
        self.runs.append(run)
        if len(self.runs) >= self.fanout:
            self.compact()
        return shared

    def compact(self) -> None:
        merged = Table(self.history().groupBy("anchor").agg(F.min("low").alias("low")).sortWithinPartitions("anchor"), "run")
        for run in self.runs:
            run.drop()
        self.runs = [merged]


def batches_of(rows: DataFrame, n: int) -> list[DataFrame]:
    """rows cut at equal steps of doc_id, smallest first: the order in which an index would get them."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return []
    cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
    return [rows.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(cuts, cuts[1:]) if a < b]


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, row_hash, text, ranges) -> two hashes of every window that starts in the ranges."""
    names = [*DOC, "w1", "w2", "at"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for doc_id, row_hash, text, ranges in zip(*(batch.column(i) for i in range(4))):
                h = Hashes(words_of(text.as_py()))
                p = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges.as_py()]))
                n = len(p)
                columns = [np.full(n, doc_id.as_py()), np.full(n, row_hash.as_py()), h.of(p, p + window, 0).view(np.int64), h.of(p, p + window, 1).view(np.int64), p.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.select(*DOC, "text", "ranges").mapInArrow(run, "doc_id long, row_hash long, w1 long, w2 long, at int")


def covered_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, row_hash, text) -> ranges (first, last window start) that a smaller document has too, by row."""
    spark = docs.sparkSession
    cut = Table(stretches(docs, window, gram), "stretches")
    index = FingerprintIndex(spark)
    shared = None
    for batch in batches_of(cut.df, batches):
        got = index.add(batch.select("anchor", "doc_id"))
        shared = got if shared is None else shared.unionAll(got)
    schema = "doc_id long, row_hash long, first int, last int"
    if shared is None:
        return spark.createDataFrame([], schema)
    suspects = Table(attach(cut.df, shared.distinct(), ["anchor"], "inner"), "suspects")
    cut.drop()
    firsts = suspects.df.groupBy("f1", "f2").agg(F.min("doc_id").alias("smallest"))
    judged = Table(attach(suspects.df, firsts, ["f1", "f2"]), "judged")
    suspects.drop()
    whole = judged.df.filter("smallest < doc_id").select(*DOC, "first", "last")
    own = judged.df.filter("smallest = doc_id")
    differ = own.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    ranges = Table(attach(own, differ, ["anchor"], "inner").groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    single = Table(windows(docs.join(ranges.df, DOC), window), "windows")
    least = single.df.groupBy("w1", "w2").agg(F.min("doc_id").alias("smallest"))
    fine = attach(single.df, least, ["w1", "w2"]).filter("smallest < doc_id").select(*DOC, F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionAll(fine)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (the kept words joined by one space)."""
    text = text_of(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    ranges = covered_ranges(plain, window, gram, batches)
    by_row = Table(ranges.groupBy(*DOC).agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "covered")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*(batch.column(i) for i in range(3))):
                words, found = words_of(text.as_py()), ranges.as_py()
                n = len(words)
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [r["first"] for r in found], 1)
                    np.add.at(edge, [r["last"] + window for r in found], -1)
                    words = [words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0)]
                rows.append((doc_id.as_py(), n, n - len(words), b" ".join(words).decode()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_text"])

    joined = plain.join(by_row.df, DOC, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
