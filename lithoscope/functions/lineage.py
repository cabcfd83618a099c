"""Cutting lineage of iterative plans by checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that driver and executors share; one of our own only where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="lithoscope-"))
    return df.checkpoint()
