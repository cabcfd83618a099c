"""Groups from candidate buckets, without all pairs of a bucket: connected components of verified links.

A bucket says that its members may be alike. Its pivot is the member that shares the most with others (the sum of its
buckets' sizes), so that of a group of altered copies the least altered one is tried first. Each node is tried against
the heaviest of its buckets' pivots, then against those of its other buckets that are in another component still; what
is verified joins components. Then only buckets whose members are in several components are tried again, and only pairs
across components. Up to HOT members these are all such pairs. In larger buckets their number would grow with the square
of the size; there `across` names those that can be links, from what both have that the common pivot hasn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.llm.common import Table, attach

NODES = "node long, component long"
HOT = 64
#: Rows of contested buckets that get their payloads at once; what is more goes in further parts, to bound the disk they take.
AT_ONCE = 1 << 24


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of edges (a, b).

    Each round every node takes its smallest neighbour as parent, parents are followed to their roots, and the edges
    between roots are what remains; the number of rounds is logarithmic. Each round is written in the shared folder.
    """
    spark = edges.sparkSession
    left = Table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: Table | None = None
    while not left.df.isEmpty():
        both = left.df.unionAll(left.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = Table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "parents")
        while True:  # to the roots: each step doubles the reach
            up = parents.df.select(F.col("node").alias("component"), F.col("component").alias("upper"))
            jumped = attach(parents.df, up, ["component"]).withColumn("moved", F.col("upper") < F.col("component"))
            nxt = Table(jumped.select("node", F.coalesce("upper", "component").alias("component"), F.coalesce("moved", F.lit(False)).alias("moved")), "parents")
            done = nxt.df.filter("moved").isEmpty()
            parents.drop()
            parents = nxt
            if done:
                break
        roots = parents.df.select("node", "component")
        if labels is None:
            merged = Table(roots, "labels")
        else:
            up = roots.select(F.col("node").alias("component"), F.col("component").alias("upper"))
            merged = Table(attach(labels.df, up, ["component"]).select("node", F.coalesce("upper", "component").alias("component")), "labels")
            labels.drop()
        labels = merged
        at = roots.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        bt = roots.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        remaining = attach(attach(left.df, at, ["a"], "inner"), bt, ["b"], "inner").filter("ra <> rb")
        fewer = Table(remaining.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        left.drop()
        parents.drop()
        left = fewer
    left.drop()
    return labels.df if labels else spark.createDataFrame([], NODES)


def named(rows: DataFrame, labels: DataFrame, node: str, component: str) -> DataFrame:
    """rows with their node's component, which is the node itself where it has no link yet."""
    own = labels.select(F.col("node").alias(node), F.col("component").alias(component))
    return attach(rows, own, [node]).withColumn(component, F.coalesce(component, node))


@dataclass
class Buckets:
    """members (bucket, node) and how link_buckets is to take them.

    sources: the tables that members reads, dropped as soon as it has been read. across, and which crowded buckets it serves
    (the others get all pairs): see link_buckets. inline: members carry their payloads to their pivots, and unlike ones go
    there, before they become pairs; a node's one trial is then against the heaviest pivot that is likely."""

    members: DataFrame
    sources: list[Table] = field(default_factory=list)
    across: Callable[[DataFrame], DataFrame] | None = None
    served: str = "true"
    inline: bool = False


def link_buckets(members: DataFrame | Buckets, payload: DataFrame, likely: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame] | None = None, hot: int = HOT) -> DataFrame:
    """node and component of every node with a link.

    members: (bucket, node) distinct, or Buckets of them; payload: one row per node (node, signature columns). likely(x, y) tests two
    payloads, structs of those names; verify keeps the true links of pairs (a, b). across(rows) takes (pivot, home,
    node, component) of crowded buckets, home being the pivot's component, and gives the pairs of one pivot that can be
    links across components.
    """
    how = members if isinstance(members, Buckets) else Buckets(members, across=across)
    members, across, inline = how.members, how.across, how.inline
    signature = payload.select("node", F.struct(*[c for c in payload.columns if c != "node"]).alias("p"))
    sizes = Table(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    joined = Table(attach(members, sizes.df, ["bucket"], "inner"), "members")
    sizes.drop()
    for source in how.sources:
        source.drop()
    weights = joined.df.groupBy("node").agg(F.sum("size").alias("weight"))
    if inline:
        weights = attach(weights, signature, ["node"], "inner")
    weighed = Table(attach(joined.df, weights, ["node"], "inner"), "weighed")
    joined.drop()
    pivots = weighed.df.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("p"))
    pivots = pivots.select("bucket", F.col("p.w").alias("w"), F.col("p.node").alias("pivot"))
    if inline:
        pivots = attach(pivots, signature.select(F.col("node").alias("pivot"), F.col("p").alias("pp")), ["pivot"], "inner")
    led_by = attach(weighed.df.drop("weight"), pivots, ["bucket"], "inner")
    shared = Table(led_by.withColumn("hit", likely("pp", "p")).drop("p", "pp") if inline else led_by, "buckets")
    weighed.drop()
    stars = shared.df.filter("pivot <> node AND hit") if inline else shared.df.filter("pivot <> node")

    def confirmed(pairs: DataFrame) -> DataFrame:
        if inline:
            return verify(pairs)
        near = attach(attach(pairs, signature.select(F.col("node").alias("b"), F.col("p").alias("pb")), ["b"], "inner"), signature.select(F.col("node").alias("a"), F.col("p").alias("pa")), ["a"], "inner")
        return verify(Table(near.filter(likely("pa", "pb")).select("a", "b"), "likely").df)

    def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
        trees = labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return connected_components(links.select("a", "b").unionAll(trees))

    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    # One trial for each node: the heaviest pivot of all its buckets.
    heaviest = stars.groupBy("node").agg(F.min(F.struct("w", "pivot")).alias("p"))
    once = Table(heaviest.select(F.col("p.pivot").alias("x"), F.col("node").alias("y")).select(*pair).distinct(), "stars").df
    labels = connected_components(confirmed(once))
    # The pivots of other buckets, where they are of another component still.
    others = named(named(stars, labels, "node", "cn"), labels, "pivot", "cp").filter("cn <> cp").select(F.col("pivot").alias("x"), F.col("node").alias("y")).select(*pair).distinct()
    others = Table(others.join(once, ["a", "b"], "left_anti"), "stars").df
    if not others.isEmpty():
        labels = grown(labels, confirmed(others))
    # Pairs across the components that are left in a bucket.
    rows = named(shared.df, labels, "node", "component")
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("bucket")
    contested = Table(attach(rows.filter("node <> pivot"), several, ["bucket"], "inner"), "contested")
    shared.drop()
    many = (F.col("size") > hot) & F.expr(how.served)
    crowded = contested.df.filter(many) if across else contested.df.limit(0)
    # A crowded bucket's members under one pivot, the heaviest they have; pairs under one are for `across`.
    led = Table(crowded.groupBy("node").agg(F.min("component").alias("component"), F.min(F.struct("w", "pivot")).alias("p")).select("node", "component", F.col("p.pivot").alias("leader")), "led")
    # Whole buckets at a time, so that what carries payloads is bounded; most of the time that is all of them.
    n = max(1, -(-contested.df.count() // AT_ONCE))
    parts = []
    for k in range(n):
        some = contested.df.filter(F.pmod(F.xxhash64("bucket"), F.lit(n)) == k)
        full = attach(attach(some, led.df.drop("component"), ["node"]), signature, ["node"], "inner")
        full = Table(full.withColumn("leader", F.when(many, F.col("leader")) if across else F.lit(None).cast("long")), "contested")
        # The pivot has been tried against every member. Both sides are ordinary exchanges, so AQE splits a hot bucket.
        x = full.df.select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("p").alias("pa"), F.col("leader").alias("la"))
        y = full.df.select(F.col("bucket").alias("bucket_b"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("p").alias("pb"), F.col("leader").alias("lb"))
        under_one = F.coalesce(F.col("la") == F.col("lb"), F.lit(False))
        within = x.join(y, (F.col("bucket") == F.col("bucket_b")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ~under_one & likely("pa", "pb")).select("a", "b")
        parts.append(Table(within.distinct(), "within"))
        full.drop()
    contested.drop()
    plain = reduce(DataFrame.unionAll, [p.df for p in parts])
    if across and not led.df.isEmpty():
        plain = plain.unionAll(across(named(led.df.withColumnRenamed("leader", "pivot"), labels, "pivot", "home")))
    tried = Table(plain.distinct(), "across")
    for part in parts:
        part.drop()
    led.drop()
    return labels if tried.df.isEmpty() else grown(labels, verify(tried.df))
