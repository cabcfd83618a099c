"""What the operators of this subpackage share: white space, words, shared tables, joins on hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, `[\x20\x09-\x0D]`. Fixed values.
SPACES = " \t\n\x0b\x0c\r"


def text_of(text: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def without_spaces(text: Column) -> Column:
    """The text without its white space. `replace` works on bytes and keeps inside code generation."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; an empty array without any."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lithoscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Table:
    """A table written in the shared folder: it cuts lineage, survives lost executors, and can be dropped."""

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy"):
        self.spark = df.sparkSession
        self.path = os.path.join(shared_folder(self.spark), f"lithoscope-{name}-{uuid.uuid4().hex}")
        schema = df.schema
        df.write.parquet(self.path, compression=compression)
        # Spark removes a finished plan's shuffle files when the driver collects its garbage; long chains would fill disks.
        self.spark._jvm.System.gc()
        self.df = self.spark.read.schema(schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its owner clears the shared folder
            pass


def small(batches, size: int):
    """Arrow batches cut to at most `size` rows; at the end the worker hands unused memory back to the system."""
    import ctypes

    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with one row per key of groups, where a key may hold a third of all rows.

    groups is usually an aggregate by these keys. Joined as it is, both sides would keep the aggregate's
    partitioning, and Spark can't split a hot partition then. A further key, a function of the others, makes both
    sides ordinary exchanges, which AQE splits (skew join) or replaces by a broadcast below its size limit.
    """
    part = F.xxhash64(*keys)
    joined = rows.withColumn("__part", part).join(groups.withColumn("__part", part), [*keys, "__part"], how)
    return joined.drop("__part")


#: Bits of the bitmap that `marked` broadcasts.
MARKS = 1 << 26


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], marks: int = MARKS) -> DataFrame:
    """rows with maybe: false only where no row of wanted has these keys.

    The hashes of wanted's keys set bits of a bitmap, which is all that is broadcast: marks / 8 bytes (8 MB), whatever the
    corpus. The more keys, the more other rows it lets through to the join that decides; none that belongs is lost."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(marks)) + 1
    part, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot).cast("int")
    bitmap = wanted.select(part.alias("__mark"), F.bitmap_bit_position(slot).alias("__bit")).repartition("__mark").groupBy("__mark").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    found = rows.withColumns({"__mark": part, "__bit": bit}).join(F.broadcast(bitmap), "__mark", "left")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    isset = F.call_function("shiftright", byte, F.col("__bit") % 8).bitwiseAND(F.lit(1)) == 1
    return found.withColumn("maybe", F.coalesce(isset, F.lit(False))).select(*rows.columns, "maybe")


def among(rows: DataFrame, keys: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """The rows whose key is in keys, a written table: broadcast up to `most` keys (16 MB), shuffled beyond."""
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), key, "left_semi")
    return attach(rows, keys, [key], "left_semi")
