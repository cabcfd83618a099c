"""Graph operators as loops over DataFrames. Nodes: (id); edges: (from, to), repeated edges allowed.

Each round is one or two joins and an aggregate on node keys; lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.lineage import cut
from lithoscope.operators.topology import with_scalar

PAGERANK_ROUNDS, DAMPING, CUT_EVERY = 20, 0.85, 5


def invariants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """unique_ids, ends_known: what every topology must satisfy."""
    ids = nodes.agg((F.count("*") == F.count_distinct("id")).alias("unique_ids"))
    ends = edges.select(F.explode(F.array("from", "to")).alias("id")).join(nodes, "id", "left_anti").agg((F.count("*") == 0).alias("ends_known"))
    return ids.crossJoin(ends)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = PAGERANK_ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, rank after a fixed number of synchronous rounds; mass of nodes without edges is lost, the end normalised."""
    out = edges.groupBy("from").agg(F.count("*").alias("k"))
    links = cut(edges.groupBy("from", "to").agg(F.count("*").alias("w")).join(out, "from").select("from", "to", (F.col("w") / F.col("k")).alias("share")))
    size = nodes.agg(F.count("*").alias("n"))
    base = cut(with_scalar(nodes.select("id"), size).select("id", (F.lit(1.0) / F.greatest(F.lit(1), "n")).alias("even")))
    rank = base.select("id", F.col("even").alias("rank"))
    for i in range(rounds):
        got = links.join(rank.select(F.col("id").alias("from"), "rank"), "from").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        rank = base.join(got, "id", "left").select("id", ((1 - damping) * F.col("even") + damping * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        if i % CUT_EVERY == CUT_EVERY - 1:
            rank = cut(rank)
    total = rank.agg(F.sum("rank").alias("total"))
    return with_scalar(rank, total).select("id", (F.col("rank") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)).alias("rank"))


def paths_by_level(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Breadth first from all nodes at once: for each level (source, id, paths), the number of shortest paths."""
    links = cut(edges.filter("from <> to").groupBy("from", "to").agg(F.count("*").alias("w")))
    level = cut(nodes.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("source", "id")
    while True:
        step = level.join(links.withColumnRenamed("from", "id"), "id").groupBy("source", F.col("to").alias("id")).agg(F.sum(F.col("paths") * F.col("w")).alias("paths"))
        level = cut(step.join(seen, ["source", "id"], "left_anti"))
        if level.isEmpty():
            return levels
        levels.append(level)
        seen = cut(seen.unionAll(level.select("source", "id")))


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, betweenness: directed, unweighted, not normalised; repeated edges multiply paths, loops don't count.

    Dependencies flow back level by level: a predecessor gets its share of paths times one plus what its successor
    has gathered. Work and state are of the order of nodes times reachable nodes, spread over all executors.
    """
    links = cut(edges.filter("from <> to").groupBy("from", "to").agg(F.count("*").alias("w")))
    levels = paths_by_level(nodes, edges)
    below, parts = None, []
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k] if below is None else levels[k].join(below, ["source", "id"], "left")
        here = here.withColumn("delta", F.lit(0.0) if below is None else F.coalesce("delta", F.lit(0.0)))
        here = cut(here)
        parts.append(here.select("id", "delta"))
        up = here.select("source", F.col("id").alias("to"), (F.lit(1.0) / F.col("paths") * (1 + F.col("delta"))).alias("share")).join(links, "to")
        above = levels[k - 1].select("source", F.col("id").alias("from"), "paths")
        below = up.join(above, ["source", "from"]).groupBy("source", F.col("from").alias("id")).agg(F.sum(F.col("share") * F.col("paths") * F.col("w")).alias("delta"))
    total = nodes.select("id", F.lit(0.0).alias("delta"))
    for p in parts:
        total = total.unionAll(p)
    return total.groupBy("id").agg(F.sum("delta").alias("betweenness"))


def gateways(scores: DataFrame) -> DataFrame:
    """The twentieth of the nodes with the largest betweenness, one at least."""
    n = scores.count()
    return scores.orderBy(F.desc("betweenness"), "id").limit(max(1, -(-n // 20)))


def stability_index(n, m):
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - m / (n * n))))


def reach(edges: DataFrame, starts: DataFrame, backward: bool = False) -> DataFrame:
    """start, id of all that each start reaches, itself included (even if it isn't a node). Semi-naive."""
    a, b = ("to", "from") if backward else ("from", "to")
    links = cut(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).filter("id <> next").distinct())
    frontier = cut(starts.select(F.col("id").alias("start"), "id").distinct())
    seen = frontier
    while True:
        step = frontier.join(links, "id").select("start", F.col("next").alias("id")).distinct()
        frontier = cut(step.join(seen, ["start", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionAll(frontier))


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, forward, backward, total."""
    f = reach(edges, nodes).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("forward"))
    b = reach(edges, nodes, True).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("backward"))
    return f.join(b, "id").withColumn("total", F.col("forward") + F.col("backward"))


def lowest_label(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label), links (id, next): every node's smallest label that reaches it along links."""
    while True:
        sent = labels.join(links, "id").groupBy(F.col("next").alias("id")).agg(F.min("label").alias("got"))
        new = cut(labels.join(sent, "id", "left").select("id", F.least("label", "got").alias("label"), (F.col("got") < F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if new.filter("moved").isEmpty():
            return labels


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id connected with it in either direction."""
    links = cut(edges.select(F.col("from").alias("id"), F.col("to").alias("next")).unionAll(edges.select("to", "from")).filter("id <> next").distinct())
    return lowest_label(nodes.select("id", F.col("id").alias("label")), links).withColumnRenamed("label", "component")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id of its strongly connected component.

    By colours: every node takes the smallest id that reaches it; what reaches the colour's own node within the colour is
    its component. Those go, and the rest starts anew. Nodes without an edge in or out go first as singletons.
    """
    links = cut(edges.select(F.col("from").alias("id"), F.col("to").alias("next")).filter("id <> next").distinct())
    rest = cut(nodes.select("id").distinct())
    done = None
    while not rest.isEmpty():
        both = links.select("id").intersect(links.select(F.col("next").alias("id")))
        single = rest.join(both, "id", "left_anti").select("id", F.col("id").alias("component"))
        core = rest.join(both, "id", "left_semi")
        colours = lowest_label(core.select("id", F.col("id").alias("label")), links)
        same = links.join(colours, "id").join(colours.select(F.col("id").alias("next"), F.col("label").alias("other")), "next").filter("label = other").select("id", "next", "label")
        back = cut(same.select(F.col("next").alias("id"), F.col("id").alias("next")))
        found = cut(colours.filter("id = label").select("id", F.col("label").alias("component")))
        front = found
        while True:
            front = cut(front.join(back, "id").select(F.col("next").alias("id"), "component").distinct().join(found, "id", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionAll(front))
        settled = single.unionAll(found)
        done = cut(settled if done is None else done.unionAll(settled))
        rest = cut(rest.join(done, "id", "left_anti"))
        links = cut(links.join(rest, "id", "left_semi").join(rest.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, members (sorted) of the strongly connected components of two nodes or more."""
    known = edges.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    return strong_components(nodes, known).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members")).filter(F.size("members") > 1)


def component_stats(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"))


def neighbours(edges: DataFrame, nodes: DataFrame, target: str) -> DataFrame:
    """relation, id of the target's impact cone: direct, reverse, depth2, reverse2; empty for an unknown target."""
    links = edges.join(nodes.select(F.col("id").alias("from")), "from", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select("from", "to").distinct()
    direct = links.filter(F.col("from") == target).select(F.col("to").alias("id"))
    reverse = links.filter(F.col("to") == target).select(F.col("from").alias("id"))
    second = links.join(direct.withColumnRenamed("id", "from"), "from").select(F.col("to").alias("id")).distinct().filter(F.col("id") != target).join(direct, "id", "left_anti")
    back = links.join(reverse.withColumnRenamed("id", "to"), "to").select(F.col("from").alias("id")).distinct().filter(F.col("id") != target).join(reverse, "id", "left_anti")
    named = lambda rows, name: rows.select(F.lit(name).alias("relation"), "id")
    return named(direct, "direct").unionAll(named(reverse, "reverse")).unionAll(named(second, "depth2")).unionAll(named(back, "reverse2"))
