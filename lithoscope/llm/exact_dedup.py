"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical without white space. A narrow first pass over the table takes length and prefix hash
only. Rows alone with their length, or with their length and prefix, have no copy and leave there. The full hash
decides among the rest.

Cases: null counts as empty, so that empty, blank and null texts are one group. Ties of the code points go to the
smallest doc_id. Repeated rows with one doc_id count each in group_size; one of them is kept. An empty table gives an
empty result. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoscope.llm.common import attach, text_of, without_spaces

PREFIX = 64


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """doc_id, the normalised length in bytes, and the hash of the first code points of the normalised text."""
    text = without_spaces(text_of(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix)).alias("prefix_hash"))


def survivors(profiles: DataFrame) -> DataFrame:
    """The (n_bytes, prefix_hash) that several rows have, found by length first."""
    lengths = profiles.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    same_length = attach(profiles, lengths, ["n_bytes"], "left_semi")
    return same_length.groupBy("n_bytes", "prefix_hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    text = text_of(text_col)
    plain = without_spaces(text)
    candidates = survivors(profile(docs, id_col, text_col, prefix)).withColumn("suspect", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("n_chars"), F.octet_length(plain).alias("n_bytes"), F.xxhash64(F.substring(plain, 1, prefix)).alias("prefix_hash"), F.sha2(plain, 256).alias("text_sha256"))
    rows = attach(rows, candidates, ["n_bytes", "prefix_hash"])
    # Repeated rows of one document: the first of them stands for the document.
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("n_chars")))
    rows = rows.withColumn("nth", nth)
    groups = (
        rows.filter("suspect")
        .groupBy("text_sha256")
        .agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("best"), F.count("*").alias("size"))
        .select("text_sha256", F.col("best.doc_id").alias("best_id"), "size")
    )
    out = attach(rows, groups, ["text_sha256"])
    keep = F.coalesce("best_id", "doc_id")
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (keep.eqNullSafe(F.col("doc_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY p) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(p) AS text_sha256
FROM d WINDOW w AS (PARTITION BY p ORDER BY length(t) DESC, doc_id)
"""
