"""Folds per group against pandas on the whole group."""

import random
from datetime import datetime

import numpy as np

from corridor.operators import folds

NONE = float("nan")


def test_regression_with_one_huge_group(spark):
    draw = random.Random(1)
    rows = []
    for i in range(30_000):
        g = (1, "a") if i % 10 else draw.choice([(None, "b"), (2, None), (2, "b"), (None, None)])
        x = draw.uniform(1e6, 1e6 + 50)
        rows.append((*g, None if i % 97 == 0 else x, 3 * x + draw.gauss(0, 5)))
    df = spark.createDataFrame(rows, "g long, h string, x double, y double").repartition(40)
    found = folds.apply_by_group(df, ["g", "h"], folds.regression("x", "y"), "n long, slope double, intercept double, r2 double", fan=3, held=2)
    got = {(r.g, r.h): r for r in found.collect()}
    assert len(got) == 5
    for key, r in got.items():
        x, y = np.array([(a, b) for g, h, a, b in rows if (g, h) == key and a is not None]).T
        slope, intercept = np.polyfit(x - x.mean(), y, 1)
        assert r.n == len(x) and abs(r.slope / slope - 1) < 1e-9 and abs(r.intercept - (intercept - slope * x.mean())) < 1e-3
        assert abs(r.r2 - np.corrcoef(x, y)[0, 1] ** 2) < 1e-9


def test_no_task_gets_a_group_whole(spark):
    sizes = folds.Fold(
        start=lambda: (0, 0, 1), add=lambda s, rows: (s[0] + len(rows), max(s[1], len(rows)), 1),
        merge=lambda a, b: (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]), finish=lambda s: s,
    )
    df = spark.range(0, 50_000, 1, 25).selectExpr("id % 1 as g", "id as v")
    row = folds.apply_by_group(df, ["g"], sizes, "n long, largest long, states long", fan=5).first()
    assert (row.n, row.largest, row.states) == (50_000, 2_000, 25)


def test_keys_of_any_type_and_degenerate_groups(spark):
    stamp = datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(stamp, 9007199254740993, 1.0, 2.0), (stamp, 9007199254740993, 1.0, 4.0), (None, 1, None, 1.0), (None, 2, 1.0, 5.0), (None, 2, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, k long, x double, y double")
    schema = "n long, slope double, intercept double, r2 double"
    got = {(r.t, r.k): tuple(r)[2:] for r in folds.apply_by_group(df, ["t", "k"], folds.regression("x", "y"), schema).collect()}
    assert got == {(stamp, 9007199254740993): (2, None, None, None), (None, 1): (0, None, None, None), (None, 2): (2, 0.0, 5.0, None)}
    assert folds.apply_by_group(df.limit(0), ["t", "k"], folds.regression("x", "y"), schema).count() == 0
