"""A directory tree as a relation (path, bytes, content), by a Python data source.

Spark's own file sources skip names that begin with an underscore; this one skips only hidden and ignored names, before
it reads a byte. The listing is made once on the driver and cut into slices that executors read.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lithoscope.functions.text import IGNORED, is_binary, language
from lithoscope.operators.integrity import content_hash

SLICE_BYTES = 32 * 1024**2


class Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, hidden: bool):
        self.root, self.hidden = root, hidden

    def ignored(self, name: str) -> bool:
        return name in IGNORED or name.endswith(".tmp") or (name.startswith(".") and not self.hidden)

    def partitions(self):
        slices, now, size = [], [], 0
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if not self.ignored(d) and not os.path.islink(f"{folder}/{d}"))
            for name in sorted(names):
                full = f"{folder}/{name}"
                if self.ignored(name) or os.path.islink(full) or not os.path.isfile(full):
                    continue
                now.append(os.path.relpath(full, self.root))
                size += os.path.getsize(full)
                if size >= SLICE_BYTES:
                    slices.append(Slice(now))
                    now, size = [], 0
        return [*slices, Slice(now)]

    def read(self, partition):
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read()
            yield path, len(content), content


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, bytes bigint, content binary"

    def reader(self, schema):
        return TreeReader(self.options["path"], self.options.get("hidden", "false") == "true")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, content, text, lang, is_binary, sha256 of every file that isn't ignored."""
    spark.dataSource.register(TreeSource)
    files = spark.read.format("tree").load(root).withColumns({"lang": language("path"), "is_binary": is_binary("path")})
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("sha256", F.when(F.col("is_binary"), F.sha2("content", 256)).otherwise(F.sha2("text", 256)))


def hashed(files: DataFrame) -> DataFrame:
    return content_hash(files)


def list_snapshots(folder: str) -> list[str]:
    """Names of the snapshots in order; none without the folder."""
    path = os.path.join(folder, "snapshots")
    return sorted(e.name for e in os.scandir(path) if e.is_dir()) if os.path.isdir(path) else []
