"""Queries on edge frames: degrees, edge sets, chains."""

from __future__ import annotations

from corridor.operators import graph
from corridor.plans import views as V
from corridor.plans.registry import query


@query("degrees", V.with_views("degrees_v") + "SELECT * FROM degrees_v")
def degrees(spark, folder):
    return graph.degrees(V.edges(spark, folder))


@query("origins", V.with_views("road_graph_v") + "SELECT DISTINCT src AS node FROM road_graph_v WHERE src NOT IN (SELECT dst FROM road_graph_v)")
def origins(spark, folder):
    return graph.origins(V.road_graph(spark, folder))


@query("merge_sinks", V.with_views("degrees_v") + "SELECT node FROM degrees_v WHERE outdegree = 0 AND indegree >= 2")
def merge_sinks(spark, folder):
    return graph.merge_sinks(V.edges(spark, folder))


@query("successors", V.with_views("edges_v") + "SELECT src, dst FROM edges_v WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)")
def successors(spark, folder):
    nodes = V.table(spark, folder, "supplier").where("s_acctbal < 5000").selectExpr("s_suppkey as node")
    return graph.successors(V.edges(spark, folder), nodes)


ORDERS = "SELECT DISTINCT o_custkey AS src, o_custkey + 1 AS dst FROM orders"
RETURNED = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "edge_set",
    V.with_views("edges_v") + f"(SELECT src, dst FROM edges_v UNION {ORDERS}) EXCEPT {RETURNED}",
)
def edge_set(spark, folder):
    more = V.table(spark, folder, "orders").selectExpr("o_custkey as src", "o_custkey + 1 as dst")
    gone = V.table(spark, folder, "lineitem").where("l_returnflag = 'R'").selectExpr("l_suppkey as src", "l_partkey as dst")
    return graph.remove_edges(graph.add_edges(V.edges(spark, folder), more), gone)


@query(
    "reverse_edges",
    V.with_views("edges_v") + f"""SELECT DISTINCT CASE WHEN r.src IS NOT NULL THEN e.dst ELSE e.src END AS src,
        CASE WHEN r.src IS NOT NULL THEN e.src ELSE e.dst END AS dst FROM edges_v e LEFT JOIN ({RETURNED}) r ON e.src = r.src AND e.dst = r.dst""",
)
def reverse_edges(spark, folder):
    chosen = V.table(spark, folder, "lineitem").where("l_returnflag = 'R'").selectExpr("l_suppkey as src", "l_partkey as dst")
    return graph.reverse_edges(V.edges(spark, folder), chosen)


CHAINS = V.with_views(
    "road_graph_v", recursive=True,
    more="""through AS (
        SELECT a.node FROM (SELECT dst AS node, count(*) AS n FROM road_graph_v GROUP BY dst) a
        JOIN (SELECT src AS node, count(*) AS n FROM road_graph_v GROUP BY src) b USING (node) WHERE a.n = 1 AND b.n = 1),
    walk AS (
        SELECT src AS chain_src, dst AS chain_dst, 0::BIGINT AS position, src, dst FROM road_graph_v
        WHERE src NOT IN (SELECT node FROM through)
        UNION ALL
        SELECT w.chain_src, w.chain_dst, w.position + 1, e.src, e.dst FROM walk w
        JOIN through t ON w.dst = t.node JOIN road_graph_v e ON e.src = w.dst)""",
)


@query("chains", CHAINS + "SELECT * FROM walk")
def chains(spark, folder):
    return graph.chains(V.road_graph(spark, folder))[0]


@query(
    "chain_roads",
    CHAINS + """SELECT chain_src, chain_dst, position, rid FROM (
        SELECT w.*, w.src // 3 AS rid, lag(w.src // 3) OVER (PARTITION BY chain_src, chain_dst ORDER BY position) AS before
        FROM walk w JOIN road_graph_v g ON w.src = (CASE WHEN g.source = 'Brand#3' THEN -1 - g.src ELSE g.src END) AND w.dst = g.dst)
        WHERE before IS NULL OR before <> rid""",
)
def chain_roads(spark, folder):
    return graph.chain_roads(graph.chains(V.road_graph(spark, folder))[0], V.roads(spark, folder))
