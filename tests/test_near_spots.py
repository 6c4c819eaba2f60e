"""Near lines in crowded spots: leaves, blocks and representatives against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corridor.operators import spatial
from tests.conftest import LINES
from tests.test_geometry import brute_pairs, frame, groups_of


def spot(kind, n, seed=3):
    """Different lines of which many share both end cells: apart in the middle, in small clusters, or so short that boxes decide."""
    rng = random.Random(seed)
    shapes = set()
    while len(shapes) < n:
        if kind == "middle":
            mid = rng.randrange(6) * 3e-4
            points = [(113, 22), (113.001 + mid, 22.001), (113.002, 22.002)]
            jitter = 6e-5
        elif kind == "clusters":
            at = rng.randrange(4) * 1.1e-4
            points = [(113 + at, 22), (113.001 + at, 22.001)]
            jitter = 1.2e-5
        else:
            points = [(113, 22), (113, 22)]
            jitter = 2.5e-5
            x, y = rng.uniform(-4e-5, 4e-5), rng.uniform(-4e-5, 4e-5)
            points = [(113 + x, 22 + y), (113 + x + rng.choice([0, 2e-6]), 22 + y)]
            shapes.add(tuple((round(a, 7), round(b, 7)) for a, b in points))
            continue
        shapes.add(tuple((round(a + rng.uniform(-jitter, jitter), 7), round(b + rng.uniform(-jitter, jitter), 7)) for a, b in points))
    return [list(s) for s in sorted(shapes)]


@pytest.mark.parametrize("kind", ["middle", "clusters", "short"])
def test_equal_to_all_pairs(spark, kind):
    shapes = spot(kind, 300)
    want = brute_pairs(shapes, 0.5e-4, True)
    lines = frame(spark, *shapes)
    assert {(r.a, r.b) for r in spatial.near_pairs(lines, "id", crowd=12).collect()} == want
    assert {r.id: r.component for r in spatial.near_groups(lines, "id", crowd=12).collect()} == groups_of(want)


def test_blocks_bound_the_rows_of_a_key(spark):
    rows = spark.range(300).selectExpr("if(id < 280, 1L, 2L) as _leaf", "id as _id")
    found = spatial._compared(rows, rows, F.col("_id") < F.col("_id2"), block=20)
    wanted = {(a, b) for b in range(300) for a in range(b) if (a < 280) == (b < 280)}
    got = [(r.a, r.b) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted


def test_many_lines_in_one_spot(spark):
    n = 20_000
    lines = spark.range(n).selectExpr(
        "id", "transform(sequence(0, 4), i -> named_struct('lon', 113D + i * 0.001D + (xxhash64(id, i) % 1000) * 2e-8D,"
        " 'lat', 22D + i * 0.001D + (xxhash64(i, id) % 1000) * 2e-8D)) as coords")
    found = spatial.near_groups(lines, "id")
    assert found.where("component = 0").count() == n == found.count()
    assert spatial.near_groups(spark.createDataFrame([], LINES), "id").count() == 0


def test_leaves_have_few_visitors(spark):
    rng = random.Random(3)
    ends = lambda: [(rng.random(), rng.random()) for _ in range(2)]
    shapes = [ends() for _ in range(400)]
    shapes += [[(x + 1e-5, y) for x, y in shape] for shape in shapes[:50]]
    rows, calm = spatial._leaves(frame(spark, *shapes), "id", "coords", 5e-5, True, spatial.CROWD)
    assert calm and rows.count() < 2 * len(shapes) and "_box" not in rows.columns
    assert spatial.near_pairs(frame(spark, *shapes), "id").count() == 50
