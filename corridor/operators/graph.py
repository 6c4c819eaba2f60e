"""Directed graphs as edge frames ``src, dst``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.functions import geometry as G
from corridor.operators.frames import SMALL_SIDE, dense_ids, join_unique, previous_in_group, with_group_stats
from corridor.scratch import checkpoint, is_small


def endpoints(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """Add ``start`` and ``end`` point text, rounded to six decimals."""
    return lines.withColumns(
        {"start": G.point_wkt(G.start_point(F.col(coords))), "end": G.point_wkt(G.end_point(F.col(coords)))}
    )


def edge_set(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return edges.select("src", "dst").distinct()


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edge_set(edges.select("src", "dst").unionByName(more.select("src", "dst")))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edge_set(edges).join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def reverse_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Turn the selected edges round; an edge that already exists is not doubled."""
    marked = edge_set(edges).join(
        selected.select("src", "dst").distinct().withColumn("_turn", F.lit(True)), ["src", "dst"], "left"
    )
    turn = F.col("_turn").isNotNull()
    return marked.select(
        F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"),
        F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst"),
    ).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node, over distinct edges."""
    once = edge_set(edges)
    ends = once.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        once.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def origins(edges: DataFrame) -> DataFrame:
    """Nodes with successors and no predecessor."""
    return degrees(edges).where("indegree = 0 and outdegree <> 0").select("node")


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave the given nodes, one row per successor."""
    return edge_set(edges).join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi")


def merge_sinks(edges: DataFrame) -> DataFrame:
    """Nodes without successors that two or more edges reach."""
    return degrees(edges).where("outdegree = 0 and indegree >= 2").select("node")


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, cycles): maximal runs of edges through nodes with one way in and one out.

    Chain rows are ``chain_src, chain_dst, position, src, dst``, a chain being
    named by its first edge. Every edge points to the edge before it; pointers are
    doubled each round, so the rounds grow with the logarithm of the longest
    chain. Pointers of unfinished edges are all different, so no key is hot. Edges
    that never reach a first edge lie on pure cycles and are returned apart.
    """
    numbered = checkpoint(dense_ids(edge_set(edges), ["src", "dst"], "eid", F.lit(0)))
    through = degrees(numbered).where("indegree = 1 and outdegree = 1").select(F.col("node").alias("src"))
    ahead = numbered.select(F.col("dst").alias("src"), F.col("eid").alias("prev"))
    before = checkpoint(ahead.join(through, "src", "left_semi"))
    linked = join_unique(numbered, before, ["src"], "left").select(
        "eid", "src", "dst", F.col("prev").alias("jump"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.when(F.col("prev").isNull(), F.col("src")).alias("chain_src"),
        F.when(F.col("prev").isNull(), F.col("dst")).alias("chain_dst"),
    )
    state = checkpoint(linked)
    open_edges = state.where("jump is not null").count()
    while open_edges:
        ahead = state.select(
            F.col("eid").alias("jump"), F.col("jump").alias("_jump"), F.col("hops").alias("_hops"),
            F.col("chain_src").alias("_src"), F.col("chain_dst").alias("_dst"),
        )
        jumped = state.where("jump is not null").join(ahead, "jump").select(
            "eid", "src", "dst", F.col("_jump").alias("jump"), (F.col("hops") + F.col("_hops")).alias("hops"),
            F.col("_src").alias("chain_src"), F.col("_dst").alias("chain_dst"),
        )
        state = checkpoint(state.where("jump is null").unionByName(jumped))
        left = state.where("jump is not null").count()
        if left == open_edges:
            break
        open_edges = left
    done = state.where("jump is null").select(
        "chain_src", "chain_dst", F.col("hops").alias("position"), "src", "dst"
    )
    return done, state.where("jump is not null").select("src", "dst")


def chain_roads(chain_rows: DataFrame, roads: DataFrame, block: int = 65536) -> DataFrame:
    """Road ids along each chain, in order, equal neighbours collapsed."""
    chain = ["chain_src", "chain_dst"]
    named = roads.select(F.col("s").alias("src"), F.col("e").alias("dst"), "rid")
    along = checkpoint(chain_rows.join(named, ["src", "dst"]).select(*chain, "position", "rid").distinct())
    marked = previous_in_group(along, chain, "position", "rid", "rid", "_before", block)
    return marked.where(F.col("_before").isNull() | (F.col("_before") != F.col("rid"))).drop("_before")


def components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph given as pairs ``(a, b)``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round
    links nodes to the smallest neighbour, found by an aggregate and joined back,
    until the edges are stars. A component is named by its smallest node.
    """
    edges = checkpoint(pairs.select("a", "b").where("a <> b").distinct())
    with_lowest = _small_lowest if is_small(edges, SMALL_SIDE) else _lowest
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_lowest(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b"))
        low = with_lowest(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        linked = low.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = checkpoint(linked.unionByName(low.select("a", F.col("_m").alias("b"))).distinct())
        mark = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _lowest(edges: DataFrame) -> DataFrame:
    """Add each node's lowest neighbour; a hub's edges are not shuffled to one task."""
    return with_group_stats(checkpoint(edges), ["a"], _m=F.min("b"))


def _small_lowest(edges: DataFrame) -> DataFrame:
    """The same for a graph counted to be small, whose nodes fit in a broadcast."""
    return edges.join(F.broadcast(edges.groupBy("a").agg(F.min("b").alias("_m"))), "a")
