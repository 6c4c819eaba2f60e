"""The greedy fold in rounds against going through the edges one by one."""

import hashlib
import random

import pytest

from corridor.operators import heat
from tests.conftest import LINES, line


def one_by_one(freqs, pairs, cap):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    digest = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)
    leader, open_ = {}, set(near)
    for e in sorted(near, key=lambda k: (-freqs[k], digest(k), k)):
        if e not in open_:
            continue
        partners = near[e] & open_
        if not partners:
            continue
        if cap is None or round(freqs[e] + sum(freqs[p] for p in partners), 9) <= cap:
            leader.update({p: e for p in partners})
            open_ -= partners
        leader[e] = e
        open_.discard(e)
    return leader


def random_graph(seed, n, links, hub=False):
    draw = random.Random(seed)
    freqs = {i: draw.choice((0.1, 0.2, 0.2, 0.3, 0.5)) for i in range(n)}
    pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(links)}
    if hub:
        pairs |= {(7, i) for i in range(0, n, 2)}
    return freqs, sorted(pairs)


def found(spark, freqs, pairs, cap):
    edges = spark.createDataFrame(list(freqs.items()), "id long, freq double")
    rows = heat.fold_pairs(edges, spark.createDataFrame(pairs, "a long, b long"), cap=cap)
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got)


@pytest.mark.parametrize(("seed", "cap", "hub"), [(1, 1.0, True), (2, None, False)])
def test_equals_sequential_fold(spark, seed, cap, hub):
    freqs, pairs = random_graph(seed, 150, 210, hub)
    assert found(spark, freqs, pairs, cap) == one_by_one(freqs, pairs, cap)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(heat.join_unique, "__defaults__", (*heat.join_unique.__defaults__[:-1], 3))
    freqs, pairs = random_graph(5, 60, 80, True)
    assert found(spark, freqs, pairs, 1.0) == one_by_one(freqs, pairs, 1.0)


def test_long_row_of_equal_edges(spark):
    freqs, pairs = {i: 0.2 for i in range(3000)}, [(i, i + 1) for i in range(2999)]
    assert found(spark, freqs, pairs, None) == one_by_one(freqs, pairs, None)


def test_lines_fold_into_direct_partners_only(spark):
    rows = [(i, line((i * 4e-5, 0), (1, 1)), f) for i, f in enumerate((0.3, 0.4, 0.2, 0.2))] + [(9, line((5, 5), (6, 6)), 0.1)]
    lines = spark.createDataFrame(rows, LINES + ", freq double")
    folded = {r.id: (round(r.freq, 6), r.members) for r in heat.fold_equal_edges(lines).collect()}
    assert folded == {1: (0.9, 3), 3: (0.2, 1), 9: (0.1, 1)}
    assert {r.id for r in heat.merge_equal_edges(lines, cap=None).collect()} == {1, 9}
    assert heat.fold_equal_edges(lines.limit(0)).count() == 0
