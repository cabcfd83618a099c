"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Words and word pairs are hashed into BUCKETS. Their counts over all documents make the raw multinomial, their counts over
the trusted documents the target's. Both are brought to the target's size and smoothed by SMOOTHING a bucket, so that an
n-gram that the corpus hardly has says hardly anything, whichever side it is on. A document's score is the mean over its
n-grams of the log of the two probabilities' ratio. It is kept if it passes the base rules and its score is at least
THRESHOLD.

All the given ids are trusted; they are joined by a shuffle, which takes only the documents whose id's hash has its bit set
in a bitmap of MARKS bits, made from the trusted ids. Only this bitmap (MARKS / 8 bytes) and one number for each of BUCKETS
buckets are broadcast, whatever the corpus. Everything runs on built-in functions.

Repeated three-word windows are found inside each document: 64-bit hashes of the windows are packed with their places
(40 and 24 bits) and sorted, and neighbours with equal hashes are repeats. Where two hashes share 40 bits, and in
documents of 2^24 words or more, the whole hashes are compared instead.

Cases: null counts as empty; a document without words fails. Repeated rows are judged each. Without trusted documents the
ratio says nothing (0), and only the base rules decide. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import MARKS, Table, attach, marked, text_of, without_spaces, words_of

BUCKETS = 1 << 18
SMOOTHING = 4.0
THRESHOLD = -0.15
#: Characters that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
PLACE = (1 << 24) - 1


def repeat_columns(d: DataFrame) -> DataFrame:
    """d with w (words) and n (their number) -> with n_repeat_words."""
    long = lambda x: x.cast("long")
    same = lambda x, y: F.shiftright(x, 24) == F.shiftright(y, 24)
    place = lambda x: x.bitwiseAND(F.lit(PLACE))
    none = F.array().cast("array<long>")
    h = F.transform(F.slice("w", 1, F.col("n") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = d.withColumn("h", F.when(F.col("n") >= 3, h).otherwise(none))
    d = d.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    packed = F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(long(i))))
    d = d.withColumn("s", F.when(F.col("again") & (F.col("n") < PLACE), packed).otherwise(none))
    before = lambda i: F.get("s", i - 1)
    clash = F.exists(F.transform("s", lambda x, i: same(x, before(i)) & (F.get("h", place(x).cast("int")) != F.get("h", place(before(i)).cast("int")))), lambda x: F.coalesce(x, F.lit(False)))
    d = d.withColumn("whole", F.col("again") & ((F.col("n") >= PLACE) | clash))
    in_order = F.sort_array("h")
    d = d.withColumn("o", F.when(F.col("whole"), in_order).otherwise(none))
    twice = F.array_distinct(F.filter(F.transform("o", lambda x, i: F.when(x == F.get("o", i - 1), x)), lambda x: x.isNotNull()))
    d = d.withColumn("twice", F.when(F.col("whole"), twice).otherwise(none))
    found = lambda array, test: F.filter(F.transform(array, test), lambda x: x.isNotNull())
    alike = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    p = F.when(F.col("whole"), found("h", lambda x, i: F.when(F.array_contains("twice", x), long(i)))).otherwise(found("s", lambda x, i: F.when(alike(x, before(i)) | alike(x, F.get("s", i + 1)), place(x))))
    d = d.withColumn("p", F.when(F.col("again"), F.sort_array(p)).otherwise(none))
    # Each window covers three words; what the one before it covers counts once.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate("p", start, lambda a, x: F.struct((a.n + x + 3 - F.greatest(x, a.end)).alias("n"), (x + 3).alias("end")), lambda a: a.n)
    return d.withColumn("n_repeat_words", F.when(F.col("again"), total).otherwise(F.lit(0).cast("long"))).drop("h", "again", "s", "whole", "o", "twice", "p")


def base_measures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, row_hash, text) -> the same keys with the base measures and base_failed."""
    text = F.col("text")
    symbols = text
    for c in SYMBOLS:
        symbols = F.replace(symbols, F.lit(c), F.lit(""))
    d = docs.select("doc_id", "row_hash", words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.char_length(without_spaces(text)).cast("long").alias("word_chars"), (F.octet_length(text) - F.octet_length(symbols)).cast("long").alias("n_symbols"))
    d = d.withColumn("n", F.size("w")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    d = repeat_columns(d).withColumn("n_words", F.col("n").cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def ngrams(docs: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """docs (keys, text) -> keys and bucket, a row for each word and each pair of neighbours."""
    words = docs.select(*keys, words_of(F.col("text")).alias("w")).select(*keys, "w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("v"))
    pairs = words.select(*keys, F.inline(F.arrays_zip("w", "v")))
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    both = F.array(hashed("w"), F.when(F.col("v").isNotNull(), hashed("w", "v")))
    return pairs.select(*keys, F.explode(both).alias("bucket")).filter("bucket IS NOT NULL")


def flagged(docs: DataFrame, chosen: DataFrame, marks: int = MARKS) -> DataFrame:
    """docs (doc_id, text) -> text, target: 1 where doc_id is among chosen (distinct, written), else null."""
    d = marked(docs.select("doc_id", "text"), chosen, ["doc_id"], marks)
    # A merge join at every size: the plan that is measured on little is the plan for much.
    inside = attach(d.filter("maybe").select("doc_id", "text"), chosen.withColumn("target", F.lit(1)).hint("merge"), ["doc_id"])
    return inside.select("text", "target").unionAll(d.filter("NOT maybe").select("text", F.lit(None).cast("int").alias("target")))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """bucket and llr of every bucket of docs (doc_id, text); trusted: ids (doc_id)."""
    chosen = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    counts = ngrams(flagged(docs, Table(chosen, "trusted").df), ["target"], buckets).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("aim"))
    table = Table(counts, "ngrams").df
    sums = table.agg(F.sum("raw"), F.sum("aim")).first()
    raw, aim = (float(x or 0) for x in sums)
    expected = F.col("raw") * (aim / raw if raw else 0.0)
    return table.select("bucket", F.log((F.col("aim") + smoothing) / (expected + smoothing)).alias("llr"))


def scores(docs: DataFrame, llr: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, row_hash, score of every document with a word."""
    keys = ["doc_id", "row_hash"]
    # llr has at most `buckets` rows of two numbers, whatever the corpus.
    return ngrams(docs, keys, buckets).join(F.broadcast(llr), "bucket").groupBy(*keys).agg((F.sum("llr") / F.count("*")).alias("score"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def verdict(threshold: float = THRESHOLD) -> Column:
    return ~F.col("base_failed") & (F.coalesce("score", F.lit(0.0)) >= threshold)


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_hash, the base measures, base_failed, score, kept."""
    plain = keyed(docs, id_col, text_col)
    scored = scores(plain, ratios(plain, trusted, buckets), buckets).select(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash"), "score")
    measured = base_measures(plain)
    joined = measured.join(scored, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left").drop("id", "hash")
    return joined.withColumn("kept", verdict(threshold))


def keep_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (any columns) that the rules keep.

    The verdicts are written first: a filter on them would be pushed into the measures, and work them out again."""
    judged = Table(quality(docs, trusted, threshold).select("doc_id", "row_hash", "kept"), "verdicts").df
    good = judged.filter("kept").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of("text")) == F.col("__hash")), "left_semi")
