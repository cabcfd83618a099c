"""Facts from files as they arrive: the extractors are row-wise, so they run unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.functions.text import is_binary, language
from lithoscope.operators import extract

SCHEMA = "path string, text string, modified timestamp"


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, text, modified) rows from Parquet files in a folder."""
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return files.withColumns({"lang": language("path"), "is_binary": is_binary("path")})


def signals(files: DataFrame) -> DataFrame:
    return extract.runtime_signals(extract.script_files(files))


def signal_counts(files: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Hits by kind and window of the file's time; a version seen again within the watermark counts once."""
    once = files.withWatermark("modified", late).dropDuplicatesWithinWatermark(["path", "modified"])
    scripts = extract.script_files(once)
    hits = [F.size(F.regexp_extract_all("text", F.lit(p), 0)).alias(k) for k, p in extract.SIGNALS.items()]
    return scripts.select("modified", *hits).groupBy(F.window("modified", window)).agg(*[F.sum(k).alias(k) for k in extract.SIGNALS])
