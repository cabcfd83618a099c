"""Scores of a repository and of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import clamp, rounded

#: Weights of gaps by severity (critical counts nothing), and of the parts of health and risk. Fixed values.
GAP_WEIGHTS = {"high": 0.4, "medium": 0.2, "low": 0.05}
RISK_PARTS = (("centrality", 1, 40), ("cone", 50, 30), ("tests", 20, 20), ("radius", 50, 10))


def stability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m, stability (one less the edges over the square of the nodes, within 0 and 1)."""
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    value = F.when(F.col("n") <= 0, 0.0).otherwise(clamp(1 - F.col("m") / F.nullif(F.col("n") * F.col("n"), F.lit(0))))
    return counts.select("n", "m", value.alias("stability"))


def metric_sanity(nodes: DataFrame, edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: ok, and which check failed."""
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m"))).crossJoin(ranks.agg(F.sum("rank").alias("mass")))
    n, m = F.col("n"), F.col("m")
    failed = F.when(n <= 0, "n must be > 0").when(m > n * (n - 1), "m out of range").when(F.abs(F.col("mass") - 1) > 1e-6, "ranks don't sum to 1")
    return counts.select("n", "m", failed.isNull().alias("ok"), failed.alias("failed"))


def health(stable: DataFrame, summary: DataFrame, duplicates: int, gateway_count: int) -> DataFrame:
    """One row: health, gateway_nodes, duplicate_pairs, structural_density."""
    risk = sum((F.col(k) * w for k, w in GAP_WEIGHTS.items()), F.lit(0.0))
    value = clamp(F.col("stability") * 0.7 + (1 - F.least(F.lit(1.0), risk / 10)) * 0.3)
    return stable.crossJoin(summary).select(rounded(value).alias("health"), F.lit(gateway_count).cast("long").alias("gateway_nodes"), F.lit(duplicates).cast("long").alias("duplicate_pairs"), rounded(1 - F.col("stability")).alias("structural_density"))


def risk_score(cone: DataFrame, topology: DataFrame, tests: DataFrame, target: str) -> DataFrame:
    """One row: cone, tests, radius, centrality, risk of a change of the target; tests: ids of test files."""
    kinds = cone.join(tests.select("id", F.lit(True).alias("is_test")), "id", "left")
    counted = kinds.agg(F.count_if(F.col("relation") != "reverse2").alias("cone"), F.count_distinct(F.when(F.col("is_test") & F.col("relation").isin("reverse", "reverse2"), F.col("id"))).alias("tests"))
    central = topology.filter(F.col("id") == target).agg(F.coalesce(F.max("centrality"), F.lit(0.0)).alias("centrality"))
    rows = counted.crossJoin(central).withColumn("radius", F.col("cone") + F.col("tests"))
    score = sum((clamp(F.col(c) / full) * weight for c, full, weight in RISK_PARTS), F.lit(0.0))
    return rows.select("cone", "tests", "radius", "centrality", F.floor(score + F.lit(0.5)).alias("risk"))
