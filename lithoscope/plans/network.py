"""Queries over the trade graph, and reach on the larger customer-supplier graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.operators import graph, score, topology
from lithoscope.sources.tables import GRAPH_SQL, graph as trade, table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None, prefix: str = f"WITH RECURSIVE {GRAPH_SQL}"):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = f"{prefix} {sql}"
        return f

    return keep


def six(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


@query("SELECT (SELECT count(*) = count(DISTINCT id) FROM nodes) AS unique_ids, (SELECT count(*) = 0 FROM edges WHERE a NOT IN (SELECT id FROM nodes) OR b NOT IN (SELECT id FROM nodes)) AS ends_known")
def topology_invariants(spark, d):
    return graph.invariants(*trade(spark, d))


@query("SELECT a AS \"from\", b AS \"to\" FROM edges WHERE a IN (SELECT id FROM nodes WHERE id < 'n20') AND b IN (SELECT id FROM nodes WHERE id < 'n20')")
def edges_in_repo(spark, d):
    nodes, edges = trade(spark, d)
    return topology.edges_in_repo(edges, nodes.filter("id < 'n20'")).select("from", "to")


@query("SELECT a AS \"from\", b AS \"to\" FROM edges WHERE b IN (SELECT id FROM nodes WHERE id < 'n20')")
def edge_to_node_semi(spark, d):
    nodes, edges = trade(spark, d)
    return edges.join(nodes.filter("id < 'n20'").select(F.col("id").alias("to")), "to", "left_semi").select("from", "to")


DEGREES_SQL = """, degrees AS (SELECT id, (SELECT count(*) FROM edges WHERE a = id) AS out_degree, (SELECT count(*) FROM edges WHERE b = id) AS in_degree FROM nodes)"""


@query(f"{DEGREES_SQL} SELECT id, out_degree, in_degree FROM degrees")
def out_degree(spark, d):
    nodes, edges = trade(spark, d)
    return topology.degrees(nodes, edges).select("id", F.col("out_degree").cast("long").alias("out_degree"), F.col("in_degree").cast("long").alias("in_degree"))


@query(f"{DEGREES_SQL} SELECT id, round(out_degree / greatest(1, max(out_degree) OVER ()), 6) AS centrality FROM degrees")
def centrality(spark, d):
    nodes, edges = trade(spark, d)
    none = spark.createDataFrame([], "file string, kind string")
    return topology.topology_nodes(nodes, edges, none).select("id", six("centrality"))


@query(f"{DEGREES_SQL} SELECT id, round((in_degree + out_degree) / greatest(1, count(*) OVER () - 1), 6) AS centrality FROM degrees")
def centrality_legacy(spark, d):
    return topology.centrality_legacy(*trade(spark, d)).select("id", six("centrality"))


@query("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def topology_metrics(spark, d):
    return score.stability(*trade(spark, d)).select(F.col("n").alias("node_count"), F.col("m").alias("edge_count"))


PAGERANK_SQL = """, ranks AS (
  SELECT 0 AS i, id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes
  UNION ALL
  SELECT x.i + 1, x.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(x.s, 0) FROM (
    SELECT any_value(t.i) AS i, n.id, sum(t.r / o.k) FILTER (e.a IS NOT NULL) AS s FROM nodes n CROSS JOIN ranks t LEFT JOIN edges e ON e.b = n.id AND e.a = t.id
      LEFT JOIN (SELECT a, count(*) AS k FROM edges GROUP BY a) o ON o.a = e.a WHERE t.i < 20 GROUP BY n.id) x),
pr AS (SELECT id, r / sum(r) OVER () AS rank FROM ranks WHERE i = 20)"""


@query(f"{PAGERANK_SQL} SELECT id, round(rank, 6) AS rank FROM pr")
def pagerank(spark, d):
    return graph.pagerank(*trade(spark, d)).select("id", six("rank"))


#: Shortest paths from all nodes by levels (bounded by the number of nodes), and betweenness from products of path counts.
BETWEENNESS_SQL = """, bfs AS (
  SELECT id AS s, id AS v, 0 AS dist, 1.0::DOUBLE AS sigma FROM nodes
  UNION ALL
  SELECT s, b, dist + 1, sum(sigma) FROM bfs JOIN edges ON a = v AND a <> b WHERE dist < 12 GROUP BY ALL),
short AS (SELECT s, v, min(dist) AS dist FROM bfs GROUP BY ALL),
paths AS (SELECT s, v, dist, sum(sigma) AS sigma FROM bfs JOIN short USING (s, v, dist) GROUP BY ALL),
bt AS (SELECT n.id, coalesce(x.b, 0) AS betweenness FROM nodes n LEFT JOIN (
  SELECT p.v AS id, sum(p.sigma * q.sigma / t.sigma) AS b FROM paths p JOIN paths q ON q.s = p.v JOIN paths t ON t.s = p.s AND t.v = q.v
  WHERE p.dist + q.dist = t.dist AND p.s <> p.v AND q.v <> p.v AND p.s <> q.v GROUP BY p.v) x USING (id))"""


@query(f"{BETWEENNESS_SQL} SELECT id, round(betweenness, 6) AS betweenness FROM bt")
def betweenness(spark, d):
    return graph.betweenness(*trade(spark, d)).select("id", six("betweenness"))


@query(f"{BETWEENNESS_SQL} SELECT id, round(betweenness, 6) AS betweenness FROM bt ORDER BY round(betweenness, 9) DESC, id LIMIT 2")
def gateways(spark, d):
    return graph.gateways(graph.betweenness(*trade(spark, d)).withColumn("betweenness", F.round("betweenness", 9))).select("id", six("betweenness"))


@query("SELECT round(greatest(0, least(1, 1 - (SELECT count(*) FROM edges) / (SELECT count(*) ** 2 FROM nodes))), 6) AS stability")
def stability_index(spark, d):
    return score.stability(*trade(spark, d)).select(six("stability"))


@query("SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m, true AS ok")
def metric_sanity(spark, d):
    nodes, edges = trade(spark, d)
    return score.metric_sanity(nodes, edges, graph.pagerank(nodes, edges)).select("n", "m", "ok")


@query("SELECT count(*) AS m, (SELECT count(*) FROM nodes) AS n, round(count(*) / (25.0 * 24), 6) AS density_directed, round(count(*) / 300.0, 6) AS density_undirected, round(count(*) / 25.0, 6) AS avg_out_degree, count(*) FILTER (a = b) AS self_loops, (SELECT count(*) FROM (SELECT least(a, b) AS x, greatest(a, b) AS y FROM edges GROUP BY ALL HAVING count(*) > 1)) AS multi_pairs FROM edges")
def topology_sanity(spark, d):
    return topology.sanity(*trade(spark, d)).select("n", "m", six("density_directed"), six("density_undirected"), six("avg_out_degree"), "self_loops", "multi_pairs")


def pick(p: int, c: str) -> str:
    return f"list_sort(list({c}))[1 + least(count(*) - 1, floor({p} / 100.0 * count(*)))::INT]"


@query(f"{DEGREES_SQL}{PAGERANK_SQL}{BETWEENNESS_SQL}, vals AS (SELECT 'degree' AS what, (in_degree + out_degree)::DOUBLE AS v FROM degrees UNION ALL SELECT 'in_degree', in_degree FROM degrees UNION ALL SELECT 'out_degree', out_degree FROM degrees UNION ALL SELECT 'rank', rank FROM pr UNION ALL SELECT 'betweenness', betweenness FROM bt) SELECT what, round(min(v), 6) AS least, round({pick(50, 'v')}, 6) AS median, round({pick(95, 'v')}, 6) AS p95, round(max(v), 6) AS most FROM vals GROUP BY what")
def distributions(spark, d):
    nodes, edges = trade(spark, d)
    degrees = topology.degrees(nodes, edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    kinds = {"degree": degrees, "in_degree": degrees, "out_degree": degrees, "rank": graph.pagerank(nodes, edges), "betweenness": graph.betweenness(nodes, edges)}
    out = None
    for name, rows in kinds.items():
        one = topology.distribution(rows.select(F.col(name).cast("double").alias(name)), name).select(F.lit(name).alias("what"), six("least"), six("median"), six("p95"), six("most"))
        out = one if out is None else out.unionAll(one)
    return out


TOP_SQL = {"top20_degree": ("SELECT id, in_degree + out_degree AS degree FROM degrees ORDER BY degree DESC, id LIMIT 20", DEGREES_SQL), "top20_pagerank": ("SELECT id, round(rank, 6) AS rank FROM pr ORDER BY round(rank, 9) DESC, id LIMIT 20", PAGERANK_SQL), "top20_betweenness": ("SELECT id, round(betweenness, 6) AS betweenness FROM bt ORDER BY round(betweenness, 9) DESC, id LIMIT 20", BETWEENNESS_SQL)}


@query(f"{TOP_SQL['top20_degree'][1]} {TOP_SQL['top20_degree'][0]}")
def top20_degree(spark, d):
    rows = topology.degrees(*trade(spark, d)).select("id", (F.col("in_degree") + F.col("out_degree")).cast("long").alias("degree"))
    return topology.top_by(rows, "degree", 20)


@query(f"{TOP_SQL['top20_pagerank'][1]} {TOP_SQL['top20_pagerank'][0]}")
def top20_pagerank(spark, d):
    return topology.top_by(graph.pagerank(*trade(spark, d)).withColumn("rank", F.round("rank", 9)), "rank", 20).select("id", six("rank"))


@query(f"{TOP_SQL['top20_betweenness'][1]} {TOP_SQL['top20_betweenness'][0]}")
def top20_betweenness(spark, d):
    return topology.top_by(graph.betweenness(*trade(spark, d)).withColumn("betweenness", F.round("betweenness", 9)), "betweenness", 20).select("id", six("betweenness"))


REACH_SQL = """, fw AS (SELECT id AS s, id AS v FROM nodes UNION SELECT s, b FROM fw JOIN edges ON a = v)"""


@query(f"{REACH_SQL} SELECT s AS start, v AS id FROM fw")
def forward_reach(spark, d):
    nodes, edges = trade(spark, d)
    return graph.reach(edges, nodes)


@query(f"{REACH_SQL} SELECT v AS start, s AS id FROM fw")
def backward_reach(spark, d):
    nodes, edges = trade(spark, d)
    return graph.reach(edges, nodes, True)


COUNTS_SQL = f"{REACH_SQL}, counts AS (SELECT n.id, (SELECT count(*) FROM fw WHERE s = n.id) AS forward, (SELECT count(*) FROM fw WHERE v = n.id) AS backward FROM nodes n)"


@query(f"{COUNTS_SQL} SELECT id, forward, backward, forward + backward AS total FROM counts ORDER BY total DESC, id LIMIT 10")
def top_reach(spark, d):
    return topology.top_by(graph.reach_counts(*trade(spark, d)), "total", 10)


@query(f"{COUNTS_SQL} SELECT 'n03' AS node_id, (SELECT forward FROM counts WHERE id = 'n03') AS forward_count, (SELECT backward FROM counts WHERE id = 'n03') AS backward_count, (SELECT string_agg(id || ':' || (forward + backward), ',' ORDER BY forward + backward DESC, id) FROM (SELECT * FROM counts ORDER BY forward + backward DESC, id LIMIT 10)) AS top_nodes")
def impact_report(spark, d):
    counts = graph.reach_counts(*trade(spark, d))
    top = topology.top_by(counts, "total", 10).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("o"), "id"))), lambda x: F.concat(x["id"], F.lit(":"), (-x["o"]).cast("string"))), ",").alias("top_nodes"))
    return counts.filter("id = 'n03'").select(F.col("id").alias("node_id"), F.col("forward").alias("forward_count"), F.col("backward").alias("backward_count")).crossJoin(top)


SCC_SQL = f"{REACH_SQL}, scc AS (SELECT x.s AS id, min(x.v) AS component FROM fw x JOIN fw y ON x.s = y.v AND x.v = y.s GROUP BY x.s)"


@query(f"{SCC_SQL} SELECT component, string_agg(id, ',' ORDER BY id) AS members FROM scc GROUP BY component HAVING count(*) > 1")
def scc_cycles(spark, d):
    return graph.cycles(*trade(spark, d)).select("component", F.array_join("members", ",").alias("members"))


@query(f"{SCC_SQL} SELECT count(*) AS components, max(k) AS largest FROM (SELECT component, count(*) AS k FROM scc GROUP BY component)")
def scc_stats(spark, d):
    return graph.component_stats(graph.strong_components(*trade(spark, d)))


@query(", un AS (SELECT id AS s, id AS v FROM nodes UNION SELECT s, CASE WHEN a = v THEN b ELSE a END FROM un JOIN edges ON a = v OR b = v) SELECT s AS id, min(v) AS component FROM un GROUP BY s")
def weak_components(spark, d):
    return graph.weak_components(*trade(spark, d))


LARGE_SQL = """WITH RECURSIVE links AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 9 = o_custkey % 9 AND l_quantity < 3),
ends AS (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links), ids AS (SELECT DISTINCT x FROM ends),
lab AS (SELECT x AS s, x AS v FROM ids UNION SELECT s, y FROM lab JOIN ends ON v = x)"""


@query("SELECT s AS id, min(v) AS component FROM lab GROUP BY s", LARGE_SQL)
def weak_components_large(spark, d):
    """Components of the thinned customer-supplier graph."""
    links = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_suppkey % 9 = o_custkey % 9 AND l_quantity < 3")
    edges = links.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to")).distinct()
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    return graph.weak_components(nodes, edges)


@query()
def weak_components_all(spark, d):
    """Components of the whole customer-supplier graph. DuckDB's recursion would hold all pairs of each component, so it has no SQL."""
    links = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = links.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to")).distinct()
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct()
    return graph.weak_components(nodes, edges)


CONE_SQL = """, d1 AS (SELECT DISTINCT b AS id FROM edges WHERE a = 'n03'), r1 AS (SELECT DISTINCT a AS id FROM edges WHERE b = 'n03'),
cone AS (SELECT 'direct' AS relation, id FROM d1 UNION ALL SELECT 'reverse', id FROM r1
  UNION ALL SELECT DISTINCT 'depth2', b FROM edges WHERE a IN (FROM d1) AND b <> 'n03' AND b NOT IN (FROM d1)
  UNION ALL SELECT DISTINCT 'reverse2', a FROM edges WHERE b IN (FROM r1) AND a <> 'n03' AND a NOT IN (FROM r1))"""


@query(f"{CONE_SQL} SELECT relation, id FROM cone")
def impact_cone(spark, d):
    nodes, edges = trade(spark, d)
    return graph.neighbours(edges, nodes, "n03")


@query(f"{CONE_SQL} SELECT DISTINCT id FROM (SELECT id FROM cone WHERE relation <> 'reverse2' UNION SELECT 'n03')")
def union_nodes(spark, d):
    nodes, edges = trade(spark, d)
    return graph.neighbours(edges, nodes, "n03").filter("relation <> 'reverse2'").select("id").unionAll(spark.createDataFrame([("n03",)], "id string")).distinct()
