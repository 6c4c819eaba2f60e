import random

import pytest

from corridor.operators import graph


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_sets(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("b", "c"))
    assert rows(graph.edge_set(e)) == [("a", "b"), ("b", "c")]
    assert rows(graph.add_edges(e, edges(spark, ("b", "c"), ("c", "d")))) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert rows(graph.remove_edges(e, edges(spark, ("a", "b")))) == [("b", "c")]
    assert rows(graph.reverse_edges(edges(spark, ("a", "b"), ("b", "a"), ("b", "c")), edges(spark, ("a", "b")))) == [("b", "a"), ("b", "c")]


def test_degrees_and_nodes(spark):
    e = edges(spark, ("a", "c"), ("b", "c"), ("a", "c"), ("x", "y"))
    assert rows(graph.degrees(e)) == [("a", 0, 1), ("b", 0, 1), ("c", 2, 0), ("x", 0, 1), ("y", 1, 0)]
    assert rows(graph.origins(e)) == [("a",), ("b",), ("x",)]
    assert rows(graph.merge_sinks(e)) == [("c",)]
    assert rows(graph.successors(e, spark.createDataFrame([("a",), ("c",)], "node string"))) == [("a", "c")]


def chain_lists(found):
    out = {}
    for r in found.orderBy("chain_src", "chain_dst", "position").collect():
        out.setdefault((r.chain_src, r.chain_dst), []).append(r.src + r.dst)
    return sorted(out.values())


def test_chains(spark):
    e = edges(
        spark, ("a", "b"), ("b", "c"), ("c", "d"), ("c", "e"), ("e", "f"), ("x", "y"),
        ("p", "q"), ("q", "p"), ("s", "s"), ("m", "k"), ("n", "k"), ("k", "l"),
    )
    found, cycles = graph.chains(e)
    assert chain_lists(found) == [["ab", "bc"], ["cd"], ["ce", "ef"], ["kl"], ["mk"], ["nk"], ["xy"]]
    assert rows(cycles) == [("p", "q"), ("q", "p"), ("s", "s")]


def test_long_chain_and_hub(spark):
    pairs = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("hub", f"h{i}") for i in range(50)]
    found, cycles = graph.chains(edges(spark, *pairs))
    assert cycles.count() == 0 and found.count() == 350
    assert max(r.position for r in found.collect()) == 299


@pytest.mark.parametrize("block", [2, 65536])
def test_chain_roads_collapse_neighbours(spark, block):
    e = edges(spark, *[(f"n{i}", f"n{i + 1}") for i in range(7)])
    found, _ = graph.chains(e)
    named = [(f"n{i}", f"n{i + 1}", rid) for i, rid in enumerate([1, 1, None, 1, 2, 2, 1]) if rid is not None]
    roads = spark.createDataFrame(named, "s string, e string, rid int")
    got = graph.chain_roads(found, roads, block).orderBy("position").collect()
    assert [(r.position, r.rid) for r in got] == [(0, 1), (4, 2), (6, 1)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 400)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert graph.components(df.where("a < 0")).count() == 0
