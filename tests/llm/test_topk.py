"""Exact top-k search against a full scan in plain Python."""

import math
import random

import numpy as np
import pytest

from corridor.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, row string, block int, rank int"
EXTRA = (1, 2, "r", 3, 4)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def whole(vector):
    if not vector or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [min(max(math.floor(256 * float(np.float32(x))), -(2**63)), 2**63 - 1) for x in vector]


def expected(rows, k):
    kept = [(i, x) for i, v in rows if (x := whole(v)) is not None]
    out = []
    for at, (q, x) in enumerate(kept):
        if q is None or q % 50:
            continue
        scored = []
        for other, (i, y) in enumerate(kept):
            if other != at:
                score = min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1)
                scored.append((-score, i is None, i or 0))
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, rows, k, **limits):
    quantised = topk.quantise(frame(spark, rows))
    index = topk.build_index(quantised, **limits)
    result = topk.search(index, quantised.where("vec_id % 50 = 0"), k, chunk_cells=limits.get("block_cells", topk.CHUNK_CELLS))
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in result.collect()], key=str)


def test_ties_nulls_repeats_and_lengths(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-0.6, 0.6) for _ in range(6)]) for i in range(120)]
    rows += [(i, [0.25] * 6) for i in range(120, 200)]  # a third of the rows are one vector
    rows += [(50, [0.25] * 6), (50, [0.1] * 6), (None, [0.25] * 6), (None, [9.0] * 6), (200, [0.0] * 6), (0, [-1.0, 1.0])]
    rows += [(250, None), (300, []), (350, [0.1, None]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [5.0] * 9)]
    assert found(spark, rows, 5, block_rows=33) == expected(rows, 5)


def test_wide_components_saturate(spark):
    rows = [(0, [1e30, -3.0]), (50, [-2e4, 7.0]), (1, [3e4, 1.0]), (2, [-1e30, 1e20]), (3, [0.0, -0.001])]
    assert found(spark, rows, 3) == expected(rows, 3)


def test_many_chunks_and_blocks(spark):
    draw = random.Random(5)
    rows = [(i * 10, [draw.choice((-0.5, 0.0, 0.25)) for _ in range(4)]) for i in range(400)]
    assert found(spark, rows, 7, block_rows=70, block_cells=64) == expected(rows, 7)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(1, [1.0]), (2, [2.0])]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows, 5) == []


def test_slices_add_up():
    draw = np.random.default_rng(1)
    x, q = draw.integers(-300, 300, (130, 5)), draw.integers(-9, 9, (3, 5))
    bits = topk.score_slices(topk.slices_of(x, topk._width(x)), q)
    for n in range(3):
        for row in range(130):
            value = sum(int(b[n, row // 64] >> np.uint64(row % 64) & np.uint64(1)) << w for w, b in enumerate(bits))
            assert value - (1 << len(bits) - 1) == int(x[row] @ q[n])
