"""Whitening against the eigenvectors of the full covariance, computed by numpy from all distinct rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corridor.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7, "n") for i, v in rows], SCHEMA)


def whole(vector, width):
    return tuple([math.floor(256 * float(np.float32(v))) for v in vector] + [0] * (width - len(vector)))


def check(spark, rows, good):
    width = max(len(v) for _, v in good)
    distinct = sorted({whole(v, width) for _, v in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(distinct, float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = whitening.whiten(frame(spark, rows)).collect()
    k = min(4, width)
    assert len(out) == k * len(good) and {r.component for r in out} == set(range(1, k + 1))
    signs = {}
    want = {}
    for i, v in good:
        x = whole(v, width)
        want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))), []).append((np.array(x) - mean) @ vectors[:, :k])
    for r in out:
        c = r.component - 1
        options = [w[c] / math.sqrt(values[c]) for w in want[r.vec_id, r.deviation]]
        sign = signs.setdefault(c, 1 if min(abs(r.whitened - o) for o in options) < 1e-6 else -1)
        assert min(abs(sign * r.whitened - o) for o in options) < 1e-9
        assert r.n == n and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_equals_full_eigenvectors(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(400, 24)) * np.linspace(0.5, 0.1, 24)
    good = [(i, [float(v) for v in row]) for i, row in enumerate(base)]
    good += [(i, good[0][1]) for i in range(1000, 1200)] + [(None, good[5][1]), (3, good[7][1]), (9, good[2][1][:10])]
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan")] * 24), (5, [float("-inf")] * 24)]
    check(spark, good + bad, good)


def test_close_eigenvalues_and_few_dimensions(spark):
    draw = np.random.default_rng(4)
    near = [(i, [float(v) for v in row]) for i, row in enumerate(draw.normal(size=(3000, 30)) * 0.2)]
    check(spark, near, near)
    narrow = [(i, [float(v) for v in row]) for i, row in enumerate(draw.normal(size=(50, 3)) * [1.0, 0.5, 0.25])]
    check(spark, narrow, narrow)


def test_missing_variance(spark):
    flat = whitening.whiten(frame(spark, [(1, [0.5] * 20), (2, [0.5] * 20)])).collect()
    assert len(flat) == 8 and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in flat)
    line = whitening.whiten(frame(spark, [(i, [0.5 * i] + [0.25] * 19) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-12 for r in line)
    assert whitening.whiten(frame(spark, [])).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0])]
    out = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id: r.deviation for r in out} == {1: None, 2: None}


@pytest.mark.parametrize("degree", [2, 9])
def test_any_degree(spark, degree):
    draw = np.random.default_rng(6)
    rows = spark.createDataFrame([([int(v) for v in r],) for r in draw.normal(size=(300, 20)) * np.linspace(90, 40, 20)], "x array<bigint>")
    found = whitening.fit(rows, degree=degree)
    x = np.array([r.x for r in rows.collect()], float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert np.allclose(found.values, values, rtol=1e-12)
