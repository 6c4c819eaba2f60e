import math
import random

import pytest
from pyspark.sql import functions as F

from corridor import schemas
from corridor.constants import BRIDGE_RINGS
from corridor.functions import datum
from corridor.functions import geometry as G
from corridor.operators import graph, heat, paths, spatial
from corridor.scratch import new_path
from tests.conftest import LINES, line


def frame(spark, *shapes):
    return spark.createDataFrame([(i, line(*s)) for i, s in enumerate(shapes)], LINES)


def test_wkt_and_rounding(spark):
    df = frame(spark, [(113.4997005, 22.0), (-0.0000001, 100.5)], [])
    texts = [r[0] for r in df.orderBy("id").select(G.line_wkt(G.round_coords(F.col("coords")))).collect()]
    assert texts == ["LINESTRING (113.4997 22, 0 100.5)", "LINESTRING ()"]


def test_segments_edges(spark):
    df = frame(spark, [], [(1, 1)], [(1, 1), (2, 2)], [(1, 1), (1, 1), (2, 2), (1, 1)])
    assert [r[0] for r in df.orderBy("id").select(F.size(G.segments(F.col("coords")))).collect()] == [0, 0, 1, 3]
    ends = {r.id: (r.start, r.end) for r in graph.endpoints(df).collect()}
    assert ends[3] == ("POINT (1 1)", "POINT (1 1)") and ends[0] == (None, None)


def test_great_circle_and_length(spark):
    df = frame(spark, [(114.0, 22.5), (114.001, 22.501)], [(1, 1)])
    km = df.where("id = 0").select(G.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0]
    assert km == pytest.approx(math.pi * 6371.0088)
    metres = [r[0] for r in df.orderBy("id").select(G.line_length(F.col("coords"))).collect()]
    phi, a, f = math.radians(22.5005), 6378245.0, 1 / 298.3
    e2 = f * (2 - f)
    w = 1 - e2 * math.sin(phi) ** 2
    want = math.hypot(math.radians(0.001) * a / math.sqrt(w) * math.cos(phi), math.radians(0.001) * a * (1 - e2) / w**1.5)
    assert metres[0] == pytest.approx(want, rel=1e-8) and metres[1] == 0.0


def test_datum(spark):
    p = G.point(F.lit(113.5), F.lit(22.5))
    row = spark.range(1).select(
        datum.wgs84_to_gcj02(p).alias("g"), datum.gcj02_to_wgs84(datum.wgs84_to_gcj02(p)).alias("w"),
        datum.bd09_to_gcj02(datum.gcj02_to_bd09(p)).alias("b"), datum.wgs84_to_gcj02(G.point(F.lit(2.0), F.lit(48.0))).alias("far"),
        datum.shift_line(F.array(p), "gcj02", "gcj02").alias("same"),
    ).first()
    assert 0.002 < row.g.lon - 113.5 < 0.01 and abs(row.g.lat - 22.5) < 0.01
    assert abs(row.w.lon - 113.5) < 5e-5 and abs(row.b.lon - 113.5) < 1e-5
    assert tuple(row.far) == (2.0, 48.0) and tuple(row.same[0]) == (113.5, 22.5)


def test_lines_meet_bridges(spark):
    humen, hzmb = BRIDGE_RINGS[1], BRIDGE_RINGS[3]
    corner = humen[0]
    df = frame(
        spark,
        [(113.0, 23.0), (113.1, 23.1)],                                 # far away
        [(113.59, 22.80), (113.63, 22.78)],                             # crosses Humen
        [(113.76, 22.282), (113.77, 22.282)],                           # inside HZMB
        [(corner[0] - 0.01, corner[1]), corner],                        # touches a corner
        [(113.59, 22.80), (113.63, 22.78), (113.76, 22.282)],           # two bridges
        [(113.76, 22.282)],                                             # one point, inside
        [(hzmb[1][0] + 0.001, 22.0), (hzmb[1][0] + 0.001, 22.6)],       # only the boxes of both are near
        [],
    )
    want = {(0, None), (1, "Humen bridge"), (2, "HZMB"), (3, "Humen bridge"), (4, "Humen bridge"), (4, "HZMB"), (5, "HZMB"), (6, None), (7, None)}
    shapes = spatial.bridge_polygons(spark)
    for few in (64, 0):
        got = spatial.join_polygons(df, shapes, "id", few=few)
        assert {(r.id, r.bridge) for r in got.collect()} == want and got.columns == ["id", "coords", "bridge"]
    for few in (64, 0):
        padded = spatial.join_polygons(df, shapes, "id", pad=0.01, few=few).where("id = 6")
        assert [r.bridge for r in padded.collect()] == ["HZMB"]


def test_polygon_paths_agree_on_repeated_and_null_keys(spark):
    rows = [(1, [(113.59, 22.80), (113.63, 22.78)]), (1, [(113.0, 23.0), (113.1, 23.1)]), (None, [(113.76, 22.282), (113.77, 22.282)]),
            (None, [(113.0, 23.0), (113.1, 23.1)]), (1, [(113.59, 22.80), (113.63, 22.78)])]
    df = spark.createDataFrame([(i, line(*points)) for i, points in rows], LINES)
    shapes = spatial.bridge_polygons(spark)
    doubled = shapes.unionByName(shapes)
    few, grid = (
        sorted(((r.id, len(r.coords), r.bridge) for r in spatial.join_polygons(df, doubled, "id", few=n).collect()), key=str) for n in (64, 0)
    )
    assert few == grid and len(few) == 8
    assert [r[2] for r in few].count("Humen bridge") == 4 and [r[2] for r in few].count(None) == 2


def test_polygon_paths_agree_on_random_lines(spark):
    rng = random.Random(5)
    shapes = [[(113.6 + rng.uniform(-0.2, 0.2), 22.5 + rng.uniform(-0.4, 0.4)) for _ in range(rng.randint(1, 6))] for _ in range(200)]
    df, areas = frame(spark, *shapes), spatial.bridge_polygons(spark)
    small, grid = (
        {(r.id, r.bridge) for r in spatial.join_polygons(df, areas, "id", few=few, cell=0.03).collect()} for few in (64, 0)
    )
    assert small == grid and len({b for _, b in small}) > 1


def brute_pairs(shapes, tolerance, boxes):
    def box(s):
        xs, ys = [p[0] for p in s], [p[1] for p in s]
        return min(xs), min(ys), max(xs), max(ys)

    found = set()
    for i, a in enumerate(shapes):
        for j in range(i + 1, len(shapes)):
            b = shapes[j]
            if len(a) != len(b) or not a or any(math.hypot(p[0] - q[0], p[1] - q[1]) > tolerance for p, q in zip(a, b)):
                continue
            (a0, a1, a2, a3), (b0, b1, b2, b3) = box(a), box(b)
            if boxes and not (a0 <= b2 and b0 <= a2 and a1 <= b3 and b1 <= a3):
                continue
            found.add((i, j))
    return found


@pytest.mark.parametrize("boxes", [True, False])
def test_near_pairs_against_brute_force(spark, boxes):
    rng = random.Random(9)
    bases = [[(113 + rng.uniform(0, 0.001), 22 + rng.uniform(0, 0.001)) for _ in range(n)] for n in (1, 2, 2, 2, 3)]
    shapes = [
        [(round(x + rng.uniform(-6e-5, 6e-5), 6), round(y + rng.uniform(-6e-5, 6e-5), 6)) for x, y in rng.choice(bases)] for _ in range(250)
    ]
    shapes = [list(s) for s in dict.fromkeys(tuple(s) for s in shapes)]
    got = {(r.a, r.b) for r in spatial.near_pairs(frame(spark, *shapes), "id", boxes=boxes).collect()}
    want = brute_pairs(shapes, 0.5e-4, boxes)
    assert got == want and len(want) > 100


def groups_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["sparse", "dense", "flat", "tiny"])
def test_near_groups_are_what_pairs_connect(spark, kind):
    rng = random.Random(kind)
    area, jitter = {"sparse": (3e-4, 2e-5), "dense": (0, 6e-5), "flat": (0, 8e-5), "tiny": (1e-4, 2e-5)}[kind]
    wide, high = {"flat": (0.01, 0.0), "tiny": (2e-5, 2e-5)}.get(kind, (0.01, 0.01))
    shapes = set()
    while len(shapes) < 260:
        x, y = 113 + rng.uniform(-area, area), 22 + rng.uniform(-area, area)
        ends = [(x + dx + rng.uniform(-jitter, jitter), y + dy + rng.uniform(-jitter, jitter)) for dx, dy in ((0, 0), (wide, high))]
        if kind == "flat":
            ends = [(px, round(ends[0][1], 5)) for px, _ in ends]
        shapes.add(tuple((round(px, 6), round(py, 6)) for px, py in ends))
    shapes = [list(s) for s in sorted(shapes)]
    got = {r.id: r.component for r in spatial.near_groups(frame(spark, *shapes), "id", crowd=8).collect()}
    pairs = brute_pairs(shapes, 0.5e-4, True)
    assert got == groups_of(pairs) and len(pairs) > 50
    if kind == "dense":
        assert {r.id: r.component for r in spatial.near_groups(frame(spark, *shapes), "id").collect()} == got


def test_near_equal_is_directed(spark):
    a, b = (114.057868, 22.543099), (114.058, 22.544)
    near = [(a[0] + 5e-6, a[1] - 5e-6), b]
    df = frame(spark, [a, b], near, [b, a], [(113, 22), (114, 23)])
    assert {(r.a, r.b) for r in spatial.near_pairs(df, "id").collect()} == {(0, 1)}
    assert sorted((r.id, r.almost_equal) for r in spatial.almost_equal(df, "id").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [r.almost_equal_num for r in spatial.almost_equal_num(df, "id").orderBy("id").collect()] == [2, 2, 0, 0]


def test_dictionary(spark):
    a, b, c = [(1, 1), (2, 2)], [(2, 2), (1, 1)], [(3, 3), (4, 4)]
    store = paths.PathStore(spark, new_path(spark, "paths"))
    first = store.add(frame(spark, a, a, b))
    assert sorted(r.fid for r in first.collect()) == [0, 1] and store.size() == 2
    ids = {r._wkt: r.fid for r in first.collect()}
    assert {r._wkt: r.fid for r in store.add(frame(spark, a, b)).collect()} == ids
    grown = {r._wkt: r.fid for r in store.add(frame(spark, c, a)).collect()}
    assert grown == {**ids, "LINESTRING (3 3, 4 4)": 2}
    assert "LINESTRING (3 3, 4 4)" not in {r._wkt for r in store.remove(frame(spark, c)).collect()}
    again = {r._wkt: r.fid for r in paths.PathStore(spark, store.rows_path.rsplit("/", 1)[0]).add(frame(spark, c)).collect()}
    assert again["LINESTRING (3 3, 4 4)"] == 3
    found = paths.lookup(frame(spark, [(1.0000001, 1), (2, 2)], [(9, 9), (8, 8)]), store.load())
    assert sorted((r.id, r.fid) for r in found.collect() if r.fid is not None) == [(0, ids["LINESTRING (1 1, 2 2)"])]
    assert found.count() == 2 and paths.lookup(frame(spark, [(9, 9)]), store.load(), how="inner").count() == 0
    assert paths.get(store.load(), spark.createDataFrame([(0,), (77,)], "fid long")).count() == 1
    free = paths.remove(paths.upsert(paths.empty(spark), frame(spark, a, c)), frame(spark, a))
    assert [r._wkt for r in free.collect()] == ["LINESTRING (3 3, 4 4)"]


def test_null_lines_are_kept_in_lookups(spark):
    df = spark.createDataFrame([(1, None), (2, line((1, 1), (2, 2)))], LINES)
    assert sorted((r.id, r.fid is None) for r in paths.lookup(df, paths.upsert(paths.empty(spark), df)).collect()) == [(1, True), (2, False)]


def test_segment_counts_sum(spark):
    shapes = frame(spark, [(1, 1), (2, 2), (3, 3)], [(2, 2), (3, 3)], [(3, 3), (2, 2)], [(1, 1)])
    lines = shapes.withColumnRenamed("id", "fid")
    trips = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 2), (2, 0), (2, 3), (2, None)], "OD int, fid long")
    counts = {(r.a_lon, r.b_lon): r["count"] for r in heat.segment_count(trips, lines).collect()}
    assert counts == {(1.0, 2.0): 3, (2.0, 3.0): 4, (3.0, 2.0): 1}
    ratios = {(r.a_lon, r.b_lon): r.freq for r in heat.segment_ratio(trips, lines).collect()}
    assert ratios == {(1.0, 2.0): pytest.approx((2 / 3 + 1) / 2), (2.0, 3.0): 1.0, (3.0, 2.0): 1.0}


def merged(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, f"{LINES}, freq double")
    return {r.id: (round(r.freq, 9), r.members) for r in heat.merge_equal_edges(df, **kwargs).collect()}


def test_merge_groups_and_cap(spark):
    def at(d):
        return line((113 + d, 22 + d), (113.1 + d, 22.1 + d))

    rows = [(1, at(0), 0.2), (2, at(3e-5), 0.5), (3, at(6e-5), 0.3), (4, line((1, 1), (2, 2)), 0.9)]
    assert merged(spark, rows) == {2: (1.0, 3), 4: (0.9, 1)}
    heavy = [(i, c, f + 0.1) for i, c, f in rows]
    assert merged(spark, heavy) == {1: (0.3, 1), 2: (0.6, 1), 3: (0.4, 1), 4: (1.0, 1)}
    assert merged(spark, heavy, cap=None) == {2: (1.3, 3), 4: (1.0, 1)}
    tied = [(i, c, 0.25) for i, c, _ in rows]
    assert merged(spark, tied) == {1: (0.75, 3), 4: (0.25, 1)}


def test_merge_fine_keeps_the_total(spark):
    shapes = [line((113, 22), (113.1, 22.1), (113.2, 22.2)), line((113.00001, 22.00001), (113.1, 22.1)), line((113.1, 22.1), (113, 22))]
    df = spark.createDataFrame([(c, float(i + 1)) for i, c in enumerate(shapes)], "coords array<struct<lon:double,lat:double>>, freq double")
    got = sorted((r.a_lon, r.b_lon, r.freq, r.members) for r in heat.merge_fine(df).collect())
    assert got == [(113.00001, 113.1, 3.0, 2), (113.1, 113.0, 3.0, 1), (113.1, 113.2, 1.0, 1)]


def test_near_groups_of_crowded_cells(spark):
    """Two cells whose heads are far from every line of the other cell, joined by two other members."""
    base = 3.5e-5 * 3230000
    at = [base + d for d in (1e-6, 33e-6, 104e-6, 71e-6)]
    shapes = [[(x, 22.0000005), (x + 0.01, 22.0100005)] for x in at]
    pairs = brute_pairs(shapes, 0.5e-4, True)
    assert pairs == {(0, 1), (2, 3), (1, 3)}
    got = {r.id: r.component for r in spatial.near_groups(frame(spark, *shapes), "id", crowd=8).collect()}
    assert got == {i: 0 for i in range(4)}


def test_many_polygons_with_a_large_one(spark):
    """Many small rings and one over nearly everything: the grid equals the direct comparison, crowded cells cut or not."""
    rng = random.Random(8)
    spot = lambda reach: (113.6 + rng.uniform(-reach, reach), 22.5 + rng.uniform(-reach, reach))
    rings = [[(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)] for (x, y), r in ((spot(0.3), rng.choice([0.002, 0.01, 0.05])) for _ in range(90))]
    rings.append([(113.35, 22.3), (113.6, 22.15), (113.9, 22.45), (113.62, 22.8), (113.35, 22.3)])  # large
    hole = [(113.5, 22.45), (113.7, 22.45), (113.7, 22.55), (113.5, 22.55), (113.5, 22.45)]
    rows = [(f"r{i}", [line(*ring)] if i < 90 else [line(*ring), line(*hole)]) for i, ring in enumerate(rings)]
    areas = spatial.polygons(spark.createDataFrame(rows, "bridge string, rings array<array<struct<lon:double,lat:double>>>"))
    lines = [[spot(0.35)] * rng.randint(0, 1) + [spot(0.35) for _ in range(rng.randint(0, 3))] for _ in range(250)]
    lines += [[rings[3][0]], [rings[90][1], (113.6, 22.0)], [(113.6, 22.5), (113.61, 22.5)], [(113.45, 22.4), (113.45, 22.41)]]
    df = frame(spark, *lines)
    direct = {(r.id, r.bridge) for r in spatial.join_polygons(df, areas, "id", few=1000).collect()}
    assert len(direct) > 300 and any(b == "r90" for _, b in direct)
    for cell in (None, 0.01, 0.2):
        got = spatial.join_polygons(df, areas, "id", few=0, cell=cell).collect()
        assert {(r.id, r.bridge) for r in got} == direct and len(got) == len(direct)


def test_spread_join_cuts_crowded_keys(spark):
    left = spark.range(300).selectExpr("id as l", "if(id < 200, 0, id % 7) as k")
    right = spark.range(100).selectExpr("id as r", "if(id < 70, 0, id % 7) as k")
    want = sorted(tuple(r) for r in left.join(right, "k").select("l", "r").collect())
    got = spatial._spread_join(left, right, ["k"], ["l"], ["r"], most=16)
    assert sorted(tuple(r) for r in got.select("l", "r").collect()) == want
    assert max(r["count"] for r in got.groupBy("k", "_i", "_j").count().collect()) <= 40 * 40


def test_cells_follow_counted_pairs(spark):
    """Long lines over many small areas: the grid is cut finer until few edges share a cell, with the same hits."""
    rng = random.Random(5)
    spots = [(rng.random(), rng.random()) for _ in range(300)]
    rings = [(i, [line((x - 0.01, y), (x, y - 0.01), (x + 0.01, y), (x, y + 0.01), (x - 0.01, y))]) for i, (x, y) in enumerate(spots)]
    areas = spatial.polygons(spark.createDataFrame(rings, f"bridge long, rings array<{schemas.COORDS}>"))
    ways = spark.createDataFrame([(i, line(*[(rng.random(), rng.random()) for _ in range(8)])) for i in range(120)], f"id long, coords {schemas.COORDS}")
    found = lambda **more: sorted((r.id, r.bridge) for r in spatial.join_polygons(ways, areas, "id", **more).collect())
    assert found(few=0) == found(few=1000)
    cut = lambda df, c: df.select(F.explode(c).alias("s")).select("s.*")
    cell, pairs = spatial._finer(cut(ways, G.segments(F.col("coords"))), cut(areas, "edges"), 2.0)
    assert cell < 1.0 and 0 < pairs < 120 * 7 * 1200 / 2
