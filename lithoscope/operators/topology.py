"""Topology: in-repository edges, centrality, risk flags, flows, ranks and structural statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Risk flags in order, with the signal kinds that raise them. Fixed values.
FLAGS = {
    "env-mutation": ("envMutation",),
    "exec": ("spawn", "exec"),
    "net-exposure": ("httpServer", "httpsServer", "netListen", "bindAllInterfaces", "wsUpgrade"),
    "timers": ("setInterval", "setTimeout"),
    "watcher": ("chokidarWatch",),
    "writes": ("fsWrite",),
}
#: Flows by flag. Fixed values.
FLOWS = (("net-exposure", "net"), ("writes", "write"), ("exec", "exec"))
LEGACY_NET = ("httpServer", "httpsServer", "netListen", "bindAllInterfaces")


def edges_in_repo(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")


def signals_by_file(nodes: DataFrame, signals: DataFrame) -> DataFrame:
    """id and kinds (sorted, empty without signals) of every node."""
    kinds = signals.groupBy(F.col("file").alias("id")).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    return nodes.join(kinds, "id", "left").select("id", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def risk_flags(kinds, legacy: bool = False):
    """The sorted flags of an array of kinds."""
    chosen = {f: k for f, k in FLAGS.items() if not (legacy and f == "watcher")}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, k))), F.lit(f)) for f, k in chosen.items()]))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree over in-repository edges, repeated edges counted."""
    ends = edges.select(F.col("from").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("to"), F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.join(sums, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def with_scalar(rows: DataFrame, scalar: DataFrame) -> DataFrame:
    """rows with the columns of a one-row aggregate: a broadcast of one row."""
    return rows.crossJoin(F.broadcast(scalar))


def topology_nodes(nodes: DataFrame, edges: DataFrame, signals: DataFrame) -> DataFrame:
    """id, kinds, flags, out_degree, in_degree, centrality (out-degree over the largest)."""
    rows = degrees(nodes, edges_in_repo(edges, nodes)).join(signals_by_file(nodes, signals), "id")
    top = rows.agg(F.greatest(F.lit(1), F.max("out_degree")).alias("top"))
    return with_scalar(rows, top).select("id", "kinds", risk_flags(F.col("kinds")).alias("flags"), "out_degree", "in_degree", (F.col("out_degree") / F.col("top")).alias("centrality"))


def centrality_legacy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, centrality: both degrees over the number of other nodes."""
    rows = degrees(nodes, edges)
    others = nodes.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("others"))
    return with_scalar(rows, others).select("id", ((F.col("in_degree") + F.col("out_degree")) / F.col("others")).alias("centrality"))


def flows(topology: DataFrame) -> DataFrame:
    """flow_id, id, kind, flags: a row for each exposed node and way."""
    ways = F.array_compact(F.array(*[F.when(F.array_contains("flags", flag), F.lit(kind)) for flag, kind in FLOWS]))
    rows = topology.select("id", "flags", F.explode(ways).alias("kind"))
    return rows.select(F.concat_ws(":", F.lit("flow"), "id", "kind").alias("flow_id"), "id", "kind", "flags")


def flows_legacy(by_file: DataFrame) -> DataFrame:
    """flow_id, id, kind, flags: one row for a node, numbered in order of ids."""
    net = F.arrays_overlap("kinds", F.array(*map(F.lit, LEGACY_NET)))
    write = F.array_contains("kinds", "fsWrite")
    kind = F.when(net & write, "mixed").when(net, "net").when(write, "write")
    rows = by_file.select("id", kind.alias("kind"), F.array_compact(F.array(F.when(net, "net-exposure"), F.when(write, "writes"))).alias("flags")).filter("kind IS NOT NULL")
    number = F.row_number().over(Window.orderBy("id")) - 1  # one row for each exposed file, numbered globally
    return rows.select(F.concat(F.lit("flow-"), number).alias("flow_id"), "id", "kind", "flags")


def rank_entries(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, topology: DataFrame) -> DataFrame:
    """path, import_degree, export_degree, in_degree, out_degree, centrality."""
    imports = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("import_degree"))
    exports = symbols.groupBy(F.col("path").alias("id")).agg(F.count("*").alias("export_degree"))
    rows = nodes.join(imports, "id", "left").join(exports, "id", "left").join(topology.select("id", "in_degree", "out_degree", "centrality"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(F.col("id").alias("path"), *map(zero, ("import_degree", "export_degree", "in_degree", "out_degree", "centrality")))


def rank_top(entries: DataFrame, n: int = 20) -> DataFrame:
    return entries.orderBy(F.desc("centrality"), F.desc("in_degree"), F.desc("out_degree"), "path").limit(n)


def top_by(values: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the largest values, ties by id."""
    return values.orderBy(F.desc(column), "id").limit(n)


def sanity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, m, densities, average degrees, self loops, pairs with several edges in either direction."""
    pair = edges.groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.count("*").alias("k"), F.sum((F.col("from") == F.col("to")).cast("long")).alias("loops"))
    counts = pair.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"), F.coalesce(F.sum("loops"), F.lit(0)).alias("self_loops"), F.count_if(F.col("k") > 1).alias("multi_pairs"))
    n = nodes.agg(F.count("*").alias("n"))
    possible = F.col("n") * (F.col("n") - 1)
    ratio = lambda x: F.when(F.col("n") <= 1, 0.0).otherwise(F.col("m") / F.nullif(x, F.lit(0)))
    average = F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(0.0)
    return n.crossJoin(counts).select("n", "m", ratio(possible).alias("density_directed"), ratio(possible / 2).alias("density_undirected"), average.alias("avg_out_degree"), average.alias("avg_in_degree"), "self_loops", "multi_pairs")


def distribution(values: DataFrame, column: str) -> DataFrame:
    """minimum, median, p95, maximum: the elements at those places of the sorted values, none interpolated.

    Values are first counted, so that the running count that finds the places is over distinct values."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    ranked = counts.select("v", "k", F.sum("k").over(Window.orderBy("v")).alias("upto"))
    total = counts.agg(F.sum("k").alias("n"))
    at = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) / 100 * F.col("n")))
    holds = lambda p: F.min(F.when(F.col("upto") > at(p), F.col("v")))
    return with_scalar(ranked, total).agg(F.min("v").alias("least"), holds(50).alias("median"), holds(95).alias("p95"), F.max("v").alias("most"))
