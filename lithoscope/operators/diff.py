"""Differences of snapshots: files, symbols, edges, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two relations (path, sha256): one full outer join."""
    both = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def set_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths of a that b lacks."""
    return a.select("path").distinct().join(b.select("path"), "path", "left_anti")


def delta_symbols(symbols: DataFrame, delta: DataFrame) -> DataFrame:
    """change, symbol (`file::name`) of the current symbols in added and removed files."""
    touched = delta.filter("change IN ('added', 'removed')")
    return symbols.join(touched, "path").select("change", F.concat_ws("::", "path", "name").alias("symbol"))


def dependency_shifts(edges: DataFrame, delta: DataFrame) -> DataFrame:
    """shift (`from -> to`) of edges at added files, or from removed ones; repeated edges stay."""
    added = delta.filter("change = 'added'").select("path", F.lit(True).alias("hit"))
    gone = delta.filter("change IN ('added', 'removed')").select("path", F.lit(True).alias("hit"))
    at_from = edges.join(gone.select(F.col("path").alias("from"), F.col("hit").alias("f")), "from", "left")
    at_both = at_from.join(added.select(F.col("path").alias("to"), F.col("hit").alias("t")), "to", "left")
    return at_both.filter("f OR t").select(F.concat_ws(" -> ", "from", "to").alias("shift"))


def diff_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added and removed paths, sorted; the deltas of edges and risk are 0 by definition."""
    sides = set_except(after, before).withColumn("side", F.lit("added")).unionAll(set_except(before, after).withColumn("side", F.lit("removed")))
    listed = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("path"))))
    return sides.agg(listed("added").alias("added"), listed("removed").alias("removed"), F.lit(0).alias("edge_delta"), F.lit(0).alias("risk_delta"))
