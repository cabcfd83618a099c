"""SimHash of whole texts and pairs within a Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import WS

DISTANCE, BANDS = 3, 4
#: Languages whose texts are compared. Fixed values.
TEXT_LANGS = ("ts", "js", "jsx", "tsx", "json", "md", "txt", "css", "html")


def simhash64(files: DataFrame) -> DataFrame:
    """path, simhash (16 hexadecimal digits): the first 64 bits of each token's SHA-256 vote, repeated tokens as often.

    Tokens are counted within each file before they are hashed and voted; a file without tokens has all zeros."""
    tokens = files.select("path", F.explode(F.split("text", f"{WS}+")).alias("token")).filter("token <> ''")
    counted = tokens.groupBy("path", "token").agg(F.count("*").alias("n"))
    digest = F.sha2("token", 256)
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    hashed = counted.select("path", "n", half(1).alias("high"), half(9).alias("low"))
    votes = [F.sum((2 * F.shiftright(side, bit).bitwiseAND(F.lit(1)) - 1) * F.col("n")).alias(f"{side}{bit}") for side in ("high", "low") for bit in range(32)]
    summed = hashed.groupBy("path").agg(*votes)

    def word(side):
        out = F.lit(0).cast("long")
        for bit in range(32):
            out = out.bitwiseOR(F.when(F.col(f"{side}{bit}") > 0, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
        return F.lpad(F.lower(F.hex(out)), 8, "0")

    found = summed.select("path", F.concat(word("high"), word("low")).alias("simhash"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("simhash", F.lit("0" * 16)).alias("simhash"))


def hamming(a, b):
    """Different bits of two hashes of 16 digits; 999 for other lengths."""
    part = lambda h, start: F.conv(F.substring(h, start, 8), 16, 10).cast("long")
    bits = lambda start: F.bit_count(part(a, start).bitwiseXOR(part(b, start)))
    return F.when((F.char_length(a) != 16) | (F.char_length(b) != 16), 999).otherwise(bits(1) + bits(9))


def duplicate_pairs(hashes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """path_a, path_b, simhash_a, simhash_b, hamming of all pairs within the distance.

    Bands: hashes that differ in at most three bits agree in one of four quarters. Paths are joined through distinct hashes, so
    that only the answer itself, not the search, grows with the number of copies."""
    distinct = hashes.select("simhash").distinct()
    width = 16 // BANDS
    banded = distinct.select("simhash", F.posexplode(F.array(*[F.substring("simhash", 1 + width * k, width) for k in range(BANDS)])).alias("band", "key"))
    other = banded.withColumnRenamed("simhash", "near")
    near = banded.join(other, ["band", "key"]).filter(hamming(F.col("simhash"), F.col("near")) <= distance).select("simhash", "near").distinct()
    a = hashes.select(F.col("path").alias("path_a"), F.col("simhash").alias("simhash_a"))
    b = hashes.select(F.col("path").alias("path_b"), F.col("simhash").alias("simhash_b"))
    pairs = near.join(a, near.simhash == a.simhash_a).join(b, near.near == b.simhash_b).filter("path_a < path_b")
    return pairs.select("path_a", "path_b", "simhash_a", "simhash_b", hamming(F.col("simhash_a"), F.col("simhash_b")).alias("hamming"))
