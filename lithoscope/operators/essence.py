"""Essence: a bounded summary of topology and gaps, whole or around one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.operators.topology import top_by

TOP_NODES, TOP_RISKS, TOP_EVIDENCE, MAX_CHARS = 5, 10, 30, 12_000
FOCUS_EVIDENCE, FOCUS_CHARS = 10, 800


def key_risks(gaps: DataFrame, n: int = TOP_RISKS) -> DataFrame:
    return gaps.select("title").distinct().orderBy("title").limit(n)


def evidence(gaps: DataFrame, n: int = TOP_EVIDENCE, legacy: bool = False) -> DataFrame:
    """path, note of the first n pieces of evidence; the note is the title with its line, or (legacy) the snippet."""
    rows = gaps.select("title", F.inline("evidence"))
    note = F.col("note") if legacy else F.concat("title", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    return rows.select(F.col("file").alias("path"), note.alias("note")).orderBy("path", "note").limit(n)


def listed(rows: DataFrame, column: str, order, name: str) -> DataFrame:
    """One row: the values of a bounded relation in order."""
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), column))), lambda x: x[column]).alias(name))


def essence(topology: DataFrame, m: DataFrame, gaps: DataFrame, legacy: bool = False, summary: DataFrame | None = None) -> DataFrame:
    """One row: overview, key_risks, top_central, evidence. m: one row (n, m)."""
    top = listed(top_by(topology, "centrality", TOP_NODES), "id", -F.col("centrality"), "top_central")
    risks = key_risks(gaps).agg(F.sort_array(F.collect_list("title")).alias("key_risks"))
    proof = evidence(gaps, legacy=legacy).agg(F.sort_array(F.collect_list(F.struct("path", "note"))).alias("evidence"))
    row = m.crossJoin(top).crossJoin(risks).crossJoin(proof)
    if not legacy:
        overview = F.format_string("Repo has %d modules and %d edges. %d distinct risk categories detected.", "n", "m", F.size("key_risks"))
        return row.select(overview.alias("overview"), "key_risks", "top_central", "evidence")
    row = row.crossJoin(summary)
    risky = F.when(F.size("key_risks") > 0, F.concat(F.lit("Key risks: "), F.array_join("key_risks", "; "), F.lit(".")))
    overview = F.concat_ws(" ", F.format_string("Nodes: %d, edges: %d.", "n", "m"), F.format_string("Gaps: %d critical, %d high, %d medium, %d low.", "critical", "high", "medium", "low"), F.concat(F.lit("Top central: "), F.array_join("top_central", ", "), F.lit(".")), risky)
    return row.select(cropped(overview, MAX_CHARS).alias("overview"), "key_risks", "top_central", "evidence")


def cropped(text, most: int):
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def focused_essence(target: str, cone: DataFrame, edges: DataFrame, topology: DataFrame, symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: overview, top_central, evidence of what lies around the target."""
    spark = cone.sparkSession
    inside = cone.filter("relation <> 'reverse2'").select("id").unionAll(spark.createDataFrame([(target,)], "id string")).distinct()
    top = top_by(topology.join(inside, "id", "left_semi"), "centrality", TOP_NODES)
    hit = cone.filter("relation IN ('reverse', 'reverse2')").join(tests, "id", "left_semi").select("id").distinct()
    notes = hit.select(F.col("id").alias("path"), F.lit("test").alias("note")).unionAll(symbols.join(top.select(F.col("id").alias("path")), "path", "left_semi").select("path", F.concat(F.lit("symbol:"), "name").alias("note")))
    within = edges.join(inside.withColumnRenamed("id", "from"), "from", "left_semi").join(inside.withColumnRenamed("id", "to"), "to", "left_semi")
    counts = cone.agg(*[F.count_if(F.col("relation") == r).alias(r) for r in ("direct", "reverse", "depth2")])
    row = counts.crossJoin(inside.agg(F.count("*").alias("n"))).crossJoin(within.agg(F.count("*").alias("m"))).crossJoin(hit.agg(F.count("*").alias("t")))
    row = row.crossJoin(listed(top, "id", -F.col("centrality"), "top_central")).crossJoin(notes.orderBy("path", "note").limit(FOCUS_EVIDENCE).agg(F.sort_array(F.collect_list(F.struct("path", "note"))).alias("evidence")))
    overview = F.format_string("Focus: %s. Cone nodes: %d, edges: %d. Direct imports: %d. Reverse imports: %d. Indirect (depth 2): %d. Impacted tests: %d.", F.lit(target), "n", "m", "direct", "reverse", "depth2", "t")
    return row.select(cropped(overview, FOCUS_CHARS).alias("overview"), "top_central", "evidence")


def essence_markdown(pack: DataFrame) -> DataFrame:
    """One row: text."""
    item = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    lines = F.concat(F.array(F.lit("# Essence Pack"), F.lit(""), F.col("overview"), F.lit(""), F.lit("## Top Central Nodes")), item("top_central"), F.array(F.lit(""), F.lit("## Key Risks")), item("key_risks"))
    return pack.select(F.array_join(lines, "\n").alias("text"))
