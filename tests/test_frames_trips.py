import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corridor.operators import frames, quality, steps, trips


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(1)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(5000)] + [0.5] * 2500,
        "tied": [1.0] * 400 + [2.0], "one": [7.0], "two": [1.0, 2.0],
        "wide": [10.0**rng.randint(-5, 9) for _ in range(300)],
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    for margin in (0.0, 0.002, 0.5):
        for r in frames.exact_quantiles(df, ["g"], "v", probabilities, margin).collect():
            want = np.quantile(groups[r.g], probabilities)
            assert [r[f"q{round(p * 100)}"] for p in probabilities] == pytest.approx(want, rel=1e-12), r.g
            assert r.n == len(groups[r.g])


def test_box_summary(spark):
    data = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = trips.box_summary(spark.createDataFrame([(1, v) for v in data], "g int, v double"), ["g"], "v").first()
    assert (row.q25, row.q50, row.q75, row.whisker_low, row.whisker_high, row.fliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_unique_splits_hot_keys(spark, how):
    rng = random.Random(4)
    rows = [(1, i) for i in range(3000)] + [(rng.randint(2, 2500), -i) for i in range(3000)] + [(None, 7)]
    df = spark.createDataFrame(rows, "k int, v int")
    side = spark.range(2000).selectExpr("cast(id as int) as k", "id * 3 as w")
    want = values(df.join(side, "k", how).fillna(-9), "k", "v", "w")
    for small in (100_000, 10):
        assert values(frames.join_unique(df, side, ["k"], how, small=small).fillna(-9), "k", "v", "w") == want
    plan = frames.join_unique(df, side, ["k"], how, small=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftAnti" in plan


def test_join_unique_leaves_null_keys_in_place(spark):
    """Half of the rows have a null key; without adaptive execution no partition gathers them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(0, 8000, 1, 8).selectExpr("if(id % 2 = 0, null, cast(id % 997 as int)) as k", "id as v")
        side = spark.range(997).selectExpr("cast(id as int) as k", "id * 3 as w")
        joined = frames.join_unique(df, side, ["k"], "left", small=10)
        assert joined.count() == 8000 and joined.where("k is null and w is null").count() == 4000
        sizes = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) == 500
        assert frames.join_unique(df, side, ["k"], "inner", small=10).count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dense_ids(spark):
    df = spark.range(5000).selectExpr("id * 7 as k")
    for buckets in (1, 16, 4096):
        got = frames.dense_ids(df, ["k"], "n", F.lit(100), buckets).collect()
        assert sorted(r.n for r in got) == list(range(100, 5100))
    again = {r.k: r.n for r in frames.dense_ids(df.repartition(3), ["k"], "n", F.lit(100)).collect()}
    assert again == {r.k: r.n for r in got}


def test_previous_in_group_equals_lag(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice("aaab"), rng.randint(0, 400), rng.randint(0, 3)) for _ in range(400)})
    df = spark.createDataFrame(rows, "g string, pos long, v long")
    lag = F.lag("v").over(Window.partitionBy("g").orderBy("pos", "v"))
    want = values(df.withColumn("p", lag).fillna(-1), "g", "pos", "v", "p")
    for block in (1, 7, 100, 65536):
        got = frames.previous_in_group(df, ["g"], "pos", "v", "v", "p", block).fillna(-1)
        assert values(got, "g", "pos", "v", "p") == want


def test_differences_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert {(r.x, r.surplus) for r in frames.symmetric_difference(a, b).collect()} == {(1, 1), (2, 1), (3, -1), (None, 1)}
    assert {r.x for r in frames.only_once(a, b).collect()} == {2, 3, None}


def test_consistency(spark):
    a = spark.createDataFrame([(1, 5, 7), (2, 5, 7), (3, 5, None)], "row_idx int, u int, w int")
    same = frames.consistency(a, a, ["row_idx"], ["u", "w"])
    frames.assert_consistent(same)
    b = spark.createDataFrame([(1, 6, 7), (2, 4, 7), (4, 5, 7)], "row_idx int, u int, w int")
    row = frames.consistency(a, b, ["row_idx"], ["u", "w"]).first()
    assert (row.rows_left, row.rows_right, row.rows_unmatched, row.u_differs, row.w_differs) == (3, 3, 2, 2, 0)
    with pytest.raises(ValueError):
        frames.assert_consistent(frames.consistency(a, b, ["row_idx"], ["u", "w"]))


def test_positional_join_adds_missing_columns(spark):
    left = spark.createDataFrame([(1, "a", 5)], "row_idx int, x string, u int")
    right = spark.createDataFrame([(1, "b", 6)], "row_idx int, x string, y int")
    assert frames.positional_join(left, right, ["row_idx"]).first().asDict() == {"row_idx": 1, "x": "a", "u": 5, "y": 6}


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 126, 127, 40000, 2.0, 1e300, "s", None), (2, -127, 0, 0, 0.5, 0.0, "t", None)],
        "a long, tiny long, edge long, wide int, f double, big double, s string, none long",
    )
    kinds = dict(frames.narrow_types(df).dtypes)
    assert kinds == {
        "a": "tinyint", "tiny": "tinyint", "edge": "smallint", "wide": "int", "f": "float", "big": "double",
        "s": "string", "none": "bigint",
    }


def test_outliers(spark):
    rows = [(1, "d", 10.0)] * 30 + [(1, "d", 99.0)] * 2 + [(2, "d", 5.0)] + [(3, "d", 4.0)] * 3 + [(None, "d", 4.0)]
    df = spark.createDataFrame(rows, "OD int, date string, speed double")
    kept, dropped = trips.split_outliers(df)
    assert kept.count() == 33 and dropped.count() == 4
    assert values(dropped.where("OD is not null"), "OD", "speed") == [(1, 99.0), (1, 99.0), (2, 5.0)]
    share = trips.outlier_share(df, ["OD", "date"], "speed").first()
    assert (share.total_rows, share.outliers) == (37, 4) and share.percentage == pytest.approx(400 / 37)


def test_congestion_index(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 5.0), (1, None), (2, 0.0), (None, 3.0)], "OD int, speed double")
    got = {(r.OD, r.speed): r.ci for r in trips.congestion_index(df).collect()}
    assert got == {(1, 10.0): 1.0, (1, 5.0): 2.0, (1, None): None, (2, 0.0): None}


def test_bridge_shares_sum_to_one(spark):
    rows = [("a", "b", 1, "X", 1)] * 3 + [("a", "b", 1, "Y", 1)] + [("a", "b", 1, None, 1), ("a", "b", None, "X", 1)]
    df = spark.createDataFrame(rows, "o string, d string, period int, bridge string, OD int")
    assert values(trips.bridge_share(df), "bridge", "percentage") == [("X", 0.75), ("Y", 0.25)]
    wide = trips.bridge_share_pivot(df, ["X", "Y"], [1, 2]).first()
    assert (wide["X_1"], wide["Y_1"], wide["X_2"]) == (0.75, 0.25, None)
    used = trips.uses_bridge(df).first()
    assert (used.bridges, used.uses_bridge) == (2, True)


def test_add_od_drops_unknown(spark):
    poi = spark.createDataFrame([(372, "Guangzhou", "Macao")], "OD int, o string, d string")
    df = spark.createDataFrame([("60630372", 1.5), ("60630001", 1.5)], "tripID string, speed double")
    row = trips.add_od(df, poi).collect()
    assert len(row) == 1 and (row[0].OD, row[0].o_rank, row[0].d_rank) == (372, 3, 2)
    assert dict(trips.add_od(df, poi).dtypes)["speed"] == "float"
    assert trips.by_od(trips.add_od(df, poi), 2, "Macao").count() == 1


def test_consolidate(spark):
    visited = spark.createDataFrame(
        [("60630372", date(2020, 5, 6), "5400", 9.8e4, 0, 0, 1, 7)],
        "tripID string, date date, duration string, travelDis double, toll_distance int, tolls int, traffic_lights int, fid int",
    )
    raw = spark.createDataFrame(
        [("60645372", date(2020, 5, 6), "1", 2.0, 0, 0, 1, "s"), ("60545372", date(2020, 5, 6), "1", 2.0, 0, 0, 1, "s")],
        "tripID string, date date, duration string, travelDis double, toll_distance int, tolls int, traffic_lights int, strategy string",
    )
    store = trips.consolidate(visited, raw)
    assert values(store, "time", "fid", "OD", "period") == [
        (datetime(2020, 5, 6, 6, 30), 7, 372, 3), (datetime(2020, 5, 6, 6, 45), -1, 372, 3)
    ]
    assert "strategy" not in store.columns


def test_step_frequency_can_exceed_one(spark):
    stamp = datetime(2020, 5, 6)
    df = spark.createDataFrame([(1, 1, 9, "a", stamp), (1, 1, 9, "a", stamp), (1, 1, 8, "a", stamp)], "OD int, period int, fid int, tripID string, timestamp timestamp_ntz")
    assert values(steps.step_frequency(df), "fid", "nums", "freq") == [(8, 1, 1.0), (9, 2, 2.0)]


def test_bridge_congestion_over_both_eras(spark):
    stamp = datetime(2020, 5, 6, 6, 45)
    series = spark.createDataFrame([(1, stamp, 1, 50.0), (4, stamp.replace(hour=7), 1, 100.0), (1, stamp, 2, None)], "period int, timestamp timestamp_ntz, bridge int, avg_speed double")
    got = steps.bridge_congestion(series)
    assert {(r.bridge, r.period): r.ci for r in got.collect()} == {("Humen bridge", 1): 2.0, ("Humen bridge", 4): 1.0, ("Nanshan bridge", 1): None}
    assert steps.drop_off_cadence(got).count() == 1


def test_day_coverage(spark):
    rows = [("t1", "r", date(2020, 5, 1)), ("t2", "r", date(2020, 5, 1)), ("t1", "r", date(2020, 5, 2)), ("t1", None, date(2020, 5, 2))]
    df = spark.createDataFrame(rows, "tripID string, road string, date date")
    row = steps.day_coverage(df, 1).collect()
    assert [(r.road, r.date_count, r.date_lst) for r in row] == [("r", 2, [date(2020, 5, 1), date(2020, 5, 2)])]


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "r"), (2, "c", "r")], "stepID int, tripID string, road string")
    assert values(quality.counts_by(df, "stepID", "road"), "stepID", "n") == [(1, 1), (2, 1)]
    assert [r.tripID for r in quality.top_steps(df, "stepID", ["tripID"], 2).collect()] == ["c", "a"]
    other = df.where("stepID = 1")
    assert values(quality.reconcile_counts(df, other, "stepID", "tripID"), "stepID", "same") == [(1, True), (2, False)]


def test_pieces(spark):
    got = frames.apply_in_pieces(spark.range(10), lambda p: p.assign(y=p["id"] * 2), "id long, y long")
    assert values(got, "y") == [(2 * i,) for i in range(10)]


def test_compose_and_int_casts(spark):
    df = spark.createDataFrame([("1.9", "x")], "a string, b string")
    got = frames.compose(df, [lambda f: frames.cast_ints(f, ["a", "b"]), lambda f: f.withColumn("c", F.col("a") + 1)])
    assert tuple(got.first()) == (1, None, 2)
