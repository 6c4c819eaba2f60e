"""Lines and many polygons in blocks of lines: what is shuffled, pieces of polygons, odd rows."""

import random

import pyarrow as pa
import pytest

from corridor import schemas
from corridor.operators import line_blocks, spatial
from tests.conftest import line


def _shuffled(plan):
    """Rows that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _shuffled(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(_shuffled(below.apply(i)) for i in range(below.size()))


def test_hits_of_lines_and_polygons_are_not_shuffled(spark):
    """Every line meets every polygon: what is shuffled grows with lines and polygons, not with what is found."""
    rings = [(i, [line((0.1 + i * 1e-4, 0.0), (0.9, 0.1 + i * 1e-4), (0.9, 0.9), (0.1, 0.9), (0.1 + i * 1e-4, 0.0))]) for i in range(200)]
    areas = spatial.polygons(spark.createDataFrame(rings, f"bridge long, rings array<{schemas.COORDS}>"))
    ways = spark.createDataFrame([(i, line((0.0, 0.3 + i * 1e-3), (1.0, 0.4 + i * 1e-3))) for i in range(200)], f"id long, coords {schemas.COORDS}")
    joined = spatial.join_polygons(ways, areas, "id", few=0)
    rows = joined.collect()
    assert len(rows) == 200 * 200 == len({(r.id, r.bridge) for r in rows})
    assert 0 < _shuffled(joined._jdf.queryExecution().executedPlan()) < 200 * 200 / 4


@pytest.mark.parametrize("vertices", [40, 100_000])
def test_line_blocks_find_what_single_comparisons_find(spark, monkeypatch, vertices):
    """Several blocks or one: the lines with all their columns, missing, repeated and empty ones, and labels of all kinds."""
    monkeypatch.setattr(spatial, "BLOCK_VERTICES", vertices)
    rng = random.Random(3)
    spot = lambda: (rng.uniform(0, 1), rng.uniform(0, 1))
    rings = [(None if i % 9 == 0 else f"a{i % 40}", [line(*(ring := [spot() for _ in range(rng.choice([3, 5, 90]))]), ring[0])]) for i in range(60)]
    areas = spatial.polygons(spark.createDataFrame(rings, f"bridge string, rings array<{schemas.COORDS}>"))
    shapes = [line(*[spot() for _ in range(rng.randint(1, 6))]) for _ in range(60)] + [[], None, [(0.5, None), (0.6, 0.6)], line((0.4, 0.4), (0.4, 0.4))]
    rows = [(None if i % 11 == 0 else i % 50, s, {"n": i}, [f"t{i}"]) for i, s in enumerate(shapes + shapes[:5])]
    ways = spark.createDataFrame(rows, f"id long, coords {schemas.COORDS}, more map<string,int>, tags array<string>")
    found = lambda **how: sorted((str(r) for r in spatial.join_polygons(ways, areas, "id", **how).collect()))
    want = found(few=1000)
    assert found(few=0) == want and found(few=0, cell=0.1) == want and len(want) > 600


@pytest.mark.parametrize("most", [1, 30, 10_000])
def test_a_block_meets_polygons_in_pieces(most):
    """Edges of one polygon over several pieces, and lines known to start inside, give each line and polygon once."""
    kind = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
    at = lambda *points: [{"lon": x, "lat": y} for x, y in points]
    rows = [{"id": 7, "coords": at((0.0, 0.5), (3.0, 0.5))}, {"id": 8, "coords": at((0.5, 0.5))}, {"id": 9, "coords": at((9.0, 9.0), (9.5, 9.0))}]
    square = lambda x: [[x, 0, x + 1, 0, x + 1, 0, x + 1, 1], [x + 1, 1, x, 1, x, 1, x, 0]]
    sent = [(None, None, None, 20 + i, row) for i, row in enumerate(rows)]
    for polygon, label, x in ((3, "near", 0.0), (4, "next", 1.0), (5, "far", 20.0)):
        sent += [(polygon, label, [float(v) for v in ends], None, None) for ends in square(x)] + [(polygon, label, None, 21, None)] * (polygon == 3)
    names, types = ["_polygon", "_label", "_ends", "_line", "_row"], [pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.struct([("id", pa.int64()), ("coords", kind)])]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*sent), types)], names)
    out = [r for b in line_blocks.meet_blocks("coords", 0.25, most)(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()]
    got = sorted((r["_row"]["id"], label) for r in out for label in r["_found"] or [""])
    assert got == [(7, "near"), (7, "next"), (8, "near"), (9, "")]
