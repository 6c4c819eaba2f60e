from datetime import date, datetime

import pytest

from corridor import schemas
from corridor.operators import frames, paths, spatial
from corridor.operators.paths import PathStore
from corridor.plans import jobs
from corridor.scratch import new_path, stored
from tests.conftest import line

C = f"coords {schemas.COORDS}"
DAY = date(2020, 5, 6)


def store(spark):
    return PathStore(spark, new_path(spark, "paths"))


def test_trip_day_checks_siblings(spark):
    features = spark.createDataFrame(
        [(DAY, 0, "372", "5400", "98000.0", "3", line((1, 1), (2, 2))), (DAY, 1, "5", "60", "10", "0", line((1, 1), (2, 2)))],
        f"date date, row_idx long, tripID string, duration string, travelDis string, traffic_lig string, {C}",
    )
    csv = spark.createDataFrame(
        [(DAY, 0, "60630372", 5400, 98000.0), (DAY, 1, "60630005", 60, 10.0)],
        "date date, row_idx long, tripID string, duration int, travelDis double",
    )
    got = sorted((r.OD, r.tripID, r.t, r.fid, r.traffic_lights) for r in jobs.trip_day(features, csv, store(spark)).collect())
    assert got == [(5, "60630005", 6.5, 0, 0), (372, "60630372", 6.5, 0, 3)]
    wrong = csv.withColumn("duration", csv.duration + 1)
    with pytest.raises(ValueError):
        jobs.trip_day(features, wrong, store(spark))
    assert jobs.trip_day(features, wrong, store(spark), check=False).count() == 2


def test_old_step_day(spark):
    df = spark.createDataFrame([("06063037203", 372, 1000, 100, line((1, 1), (2, 2)))], f"ID string, tripID int, distance int, duration int, {C}")
    row = jobs.old_step_day(df, store(spark)).first()
    assert (row.day, row.time, row.step_id, row.path_id) == ("06", "0630", 3, 0) and row.speed == pytest.approx(36.0)


def test_merge_and_prepare_day(spark):
    left = spark.createDataFrame([(DAY, 0, "x")], "date date, row_idx long, ID string")
    right = spark.createDataFrame([(DAY, 0, "x", "road")], "date date, row_idx long, ID string, road string")
    assert jobs.merge_day(left, right).first().road == "road"
    poi = spark.createDataFrame([(372, "Guangzhou", "Macao")], "OD int, o string, d string")
    day = spark.createDataFrame([("60630372", 372, 0, 1.0), ("60630372", 372, 5, 1.0)], "tripID string, OD int, fid long, speed double")
    lines = spark.createDataFrame([(1, line((1, 1), (2, 2)))], f"id long, {C}")
    ready = jobs.prepare_day(day, paths.upsert(paths.empty(spark), lines), poi).collect()
    assert [(r.o, r.fid, len(r.coords)) for r in ready] == [("Guangzhou", 0, 2)]


def test_step_day_without_lines(spark):
    csv = spark.createDataFrame(
        [(DAY, i, trip, "go", "W", "r", 1, 0, 0, "", 1, "", "") for i, trip in enumerate(["60630372", "60630372", "60645372"])],
        f"date date, row_idx long, {schemas.STEPS}",
    )
    got = sorted((r.t, r.step_id, r.OD, r.fid) for r in jobs.step_day_without_lines(csv).collect())
    assert got == [(6.5, 0, 372, None), (6.5, 1, 372, None), (6.75, 0, 372, None)]


def test_bridge_series(spark):
    early = spark.createDataFrame(
        [("虎门大桥", datetime(2019, 4, 1, 7), 36.0), ("虎门大桥", datetime(2019, 4, 1, 6, 45), 72.0)],
        "instruction string, timestamp timestamp_ntz, speed double",
    )
    late = spark.createDataFrame(
        [("虎门大桥", datetime(2020, 5, 16, 7), 2000, 100, 9)], "instruction string, timestamp timestamp_ntz, distance int, duration int, period int"
    )
    got = sorted((r.period, r.bridge, round(r.ci, 9)) for r in jobs.bridge_series(early, late).collect())
    assert got == [(1, "Humen bridge", 2.0), (4, "Humen bridge", 1.0)]


def test_heat_map_and_bridge_steps(spark):
    lines = spark.createDataFrame(
        [(1, line((113.59, 22.80), (113.63, 22.78))), (2, line((113.59001, 22.80001), (113.63001, 22.78001))), (3, line((1, 1), (2, 2)))], f"id long, {C}"
    )
    dictionary = paths.upsert(paths.empty(spark), lines)
    fid = {r._wkt: r.fid for r in dictionary.collect()}
    far = fid["LINESTRING (1 1, 2 2)"]
    freq = spark.createDataFrame([(372, 4, f, 2 + f) for f in fid.values()] + [(5, 4, far, 9)], "OD int, period int, fid long, nums long")
    coarse = jobs.od_heat_map(freq, dictionary, 372, 4)
    assert sorted((r.freq, r.members) for r in coarse.collect()) == sorted([(float(2 + far), 1), (float(2 * 3 + 3 - 2 - far), 2)])
    assert jobs.od_heat_map(freq, dictionary, 372, 4, fine=True).count() == 2
    steps = spark.createDataFrame([(f, "r") for f in fid.values()] * 2, "fid long, road string")
    crossed = jobs.steps_on_bridges(steps, dictionary, spatial.bridge_polygons(spark))
    assert {r.fid for r in crossed.collect()} == set(fid.values()) - {far} and crossed.count() == 2


def test_check_steps(spark):
    df = spark.createDataFrame([(1, "a", 0.5, DAY, "r")], "stepID int, tripID string, t double, date date, road string")
    assert {k: v.count() for k, v in jobs.check_steps(df).items()} == {"top": 1, "t": 1, "stepID": 1, "date": 1}


def test_siblings_are_never_sent_to_every_task(spark):
    rows = [(DAY, i, str(i), "60", "10", line((1, 1), (2, i))) for i in range(50)]
    features = spark.createDataFrame(rows, f"date date, row_idx long, tripID string, duration string, travelDis string, {C}")
    csv = spark.createDataFrame([(DAY, i, f"60630{i:03}", 60, 10.0) for i in range(50)], "date date, row_idx long, tripID string, duration int, travelDis double")
    left, right = (stored(df, "sibling") for df in (features, csv))
    plan = frames.positional_join(left, right, ["date", "row_idx"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = jobs.trip_day(left, right, store(spark))
    assert right.inputFiles()[0] not in found.inputFiles() and found.count() == 50


def test_step_siblings_are_joined_once(spark):
    rows = [(DAY, i, f"06{630 + i:04}3720", "372", "10", "60", "0", line((1, 1), (2, i % 3))) for i in range(20)]
    features = spark.createDataFrame(rows, f"date date, row_idx long, ID string, tripID string, distance string, duration string, tolls string, {C}")
    texts = ["instruction", "orientation", "road", "toll_road", "action", "assistant_action"]
    csv = spark.range(20).selectExpr(
        "date'2020-05-06' as date", "id as row_idx", "'372_0' as tripID", "10 as distance", "60 as duration", "0 as tolls", "0 as toll_distance",
        *[f"'x' as {c}" for c in texts],
    )
    left, right = (stored(df, "sibling") for df in (features, csv))
    found = jobs.step_day(left, right, store(spark))
    assert not {*left.inputFiles(), *right.inputFiles()} & set(found.inputFiles())
    assert found.count() == 20 and found.select("fid").distinct().count() == 3
    fewer = right.where("row_idx < 5")
    with pytest.raises(ValueError):
        jobs.step_day(left, fewer, store(spark))
    other = store(spark)
    assert jobs.step_day(left.where("row_idx <> 2"), fewer, other, check=False).count() == 4 and other.size() == 2
