import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corridor import schemas
from corridor.constants import BRIDGE_NAMES, BRIDGE_RINGS
from corridor.operators import spatial
from corridor.sources import lines, routes, sinks, tables

HEADER = "tripID,instruction,orientation,road,distance,tolls,toll_distance,toll_road,duration,action,assistant_action"


def step_file(folder, day, rows):
    path = folder / f"day_step_{day}.csv"
    path.write_text("\n".join([HEADER, *rows]) + "\n")
    return path


def test_day_files_get_their_date_and_keep_ids_as_text(spark, tmp_path):
    step_file(tmp_path, "200506", ["060630372_3,go,W, ,4600,20,0,,300,left,"])
    step_file(tmp_path, "200507", ["372_4,go,W,null,1,0,0,,0,left,"])
    got = {r.tripID: r for r in tables.read_days(spark, str(tmp_path), schemas.STEPS).collect()}
    assert got["060630372_3"].date == date(2020, 5, 6) and got["060630372_3"].distance == 4600
    assert got["372_4"].date == date(2020, 5, 7) and got["372_4"].road == "null"
    assert tables.read_csv(spark, str(tmp_path), schemas.STEPS, null_value="null").where("tripID = '372_4'").first().road is None


def test_bad_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,n\n1,x,5\n2,y,oops\n3,z\n")
    (tmp_path / "b.csv").write_text("id,name,n\n4,w,6\n")
    good, bad = tables.read_quarantine(spark, str(tmp_path), "id int, name string, n int")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x", 5), (4, "w", 6)]
    assert sorted(tuple(r) for r in bad.collect()) == [("a.csv", "2,y,oops"), ("a.csv", "3,z")]
    assert bad.count() == 2


def test_row_index_over_several_splits(spark, tmp_path):
    for name, n in (("x", 3000), ("y", 50)):
        (tmp_path / f"{name}.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(n)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        rows = tables.read_csv(spark, str(tmp_path), "n long")
        assert rows.rdd.getNumPartitions() > 3
        got = tables.file_row_index(rows)
        assert got.where("n <> row_idx").count() == 0 and got.count() == 3050
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_parquet_by_date_prunes(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "date_add(date'2020-05-01', cast(id % 4 as int)) as date")
    path = str(tmp_path / "p")
    sinks.write_by_date(df, path)
    day = spark.read.parquet(path).where(F.col("date") == F.lit("2020-05-02").cast("date"))
    assert day.count() == 25
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_geojson_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [3, 4], [(113.0, 22.5), (113.1, 22.6)])], f"id int, near array<int>, coords {schemas.COORDS}")
    sinks.write_geojson(df, str(tmp_path / "g"), list_columns=("near",))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert feature == {
        "type": "Feature", "properties": {"id": 1, "near": "[3, 4]"},
        "geometry": {"type": "LineString", "coordinates": [[113.0, 22.5], [113.1, 22.6]]},
    }
    sinks.write_csv(df.select("id"), str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), "id int").first().id == 1


def test_polygons_from_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"id": i, "bridge": BRIDGE_NAMES[i]}, "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in ring]]]}}
        for i, ring in BRIDGE_RINGS.items()
    ]
    path = tmp_path / "bridges.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    read = lines.read_polygons(spark, str(path)).select("id", "bridge", "edges", "box")
    assert sorted(read.collect()) == sorted(spatial.bridge_polygons(spark).select("id", "bridge", "edges", "box").collect())


def test_line_ingest(spark):
    df = spark.createDataFrame([(1, "113.1234567,22.5;bad;113,22.6000004", "r")], "id int, line string, road string")
    row = lines.ingest_lines(df, "line", drop=("road",))
    assert row.columns == ["id", "coords"] and [tuple(p) for p in row.first().coords] == [(113.123457, 22.5), (113.0, 22.6)]
    wkt = lines.add_geometry(row).first()._wkt
    assert wkt == "LINESTRING (113.123457 22.5, 113 22.6)"
    back = lines.ingest_lines(spark.createDataFrame([(1, wkt)], "id int, line string"), "line", wkt=True)
    assert back.first().coords == row.first().coords


ROUTE = {
    "route": {"paths": [{
        "distance": "1000", "duration": "50", "strategy": "s", "tolls": "1", "toll_distance": "2", "traffic_lights": "3",
        "steps": [
            {"instruction": "a", "distance": "600", "duration": "30", "tolls": "0", "toll_distance": "0", "polyline": "113.1,22.1;113.1,22.2;113.2,22.3",
             "tmcs": [{"lcode": "x", "distance": "300", "status": "畅通", "polyline": "113.1,22.1;113.2,22.2"},
                      {"lcode": "y", "distance": "300", "status": "?", "polyline": "113.1,22.1;113.2,22.2"}]},
            {"instruction": "b", "road": "R", "distance": "400", "duration": "20", "tolls": "0", "toll_distance": "0", "polyline": "113.2,22.3;113.3,22.4", "tmcs": []},
        ],
    }, {"distance": "9", "duration": "9", "steps": []}]}
}


@pytest.fixture
def parsed(spark):
    raw = [(372, "060630", json.dumps(ROUTE, ensure_ascii=False)), (5, "060630", "not json"), (6, "060630", '{"route":{"paths":[]}}')]
    return routes.parse_routes(spark.createDataFrame(raw, "od int, crawl string, body string"))


def test_route_trip(parsed):
    row = routes.trip_rows(parsed).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.tripID, r.duration, r.travelDis, r.speed, r.smooth, r.unknown, r.slow) == (60630372, 50, 1000.0, 20.0, 0.3, 0.3, 0.0)


def test_route_steps_and_segments(parsed):
    got = sorted((r.tripID, r.ID, r.step_id, r.road, r.distance) for r in routes.step_rows(parsed).collect())
    assert got == [("372_0", "06063037200", 0, " ", 600), ("372_1", "06063037201", 1, "R", 400)]
    parts = sorted((r.lineID, r.tripID, r.status, len(r.coords)) for r in routes.segment_rows(parsed).collect())
    assert parts == [("0606303720000", 372, 1, 2), ("0606303720001", 372, 0, 2)]


def test_route_points_need_both_coordinates_to_move(parsed):
    assert sorted((r.nodeID, r.lon, r.lat) for r in routes.point_rows(parsed).collect()) == [(0, 113.1, 22.1), (1, 113.2, 22.3), (2, 113.3, 22.4)]
    assert routes.point_rows(parsed, both=False).count() == 4


def test_unvisited_days_and_views(spark, tmp_path):
    days = spark.createDataFrame([(date(2020, 5, d),) for d in (1, 2, 3)], "date date")
    assert tables.unvisited_days(days, days.where("date = date'2020-05-02'")).count() == 2
    days.write.parquet(str(tmp_path / "d"))
    tables.register_views(spark, {"days_view": str(tmp_path / "d")})
    assert spark.sql("select count(*) from days_view").first()[0] == 3


def test_merged_steps_to_parquet(spark, tmp_path):
    from corridor.plans import jobs

    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "s.csv").write_text(f"date,{HEADER}\n20200506,60630372,go,W,R,1,0,0,,1,a,b\n")
    rows = jobs.step_csv_to_parquet(spark, str(folder), str(tmp_path / "out"))
    assert rows.first().date == date(2020, 5, 6)
    merged = spark.createDataFrame([("6063037203", "372", 20200506, "R")], "ID string, tripID string, date int, road string")
    row = jobs.steps_to_parquet(merged, str(tmp_path / "steps")).first()
    assert (row.timestamp, row.period, row.stepID) == (datetime(2020, 5, 6, 6, 30), 3, 3)


def test_writing_a_day_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "days")
    sinks.write_by_date(spark.createDataFrame([(1, "2020-05-01"), (2, "2020-05-02")], "id int, date string"), path)
    sinks.write_by_date(spark.createDataFrame([(3, "2020-05-02")], "id int, date string"), path)
    assert sorted((r.id, str(r.date)) for r in spark.read.parquet(path).collect()) == [(1, "2020-05-01"), (3, "2020-05-02")]


@pytest.mark.parametrize("both", [True, False])
def test_kept_points_of_long_routes(spark, both):
    points = [((i // 3) % 50 / 10, (i // 2) % 70 / 10) for i in range(2000)]
    want, last = [], (0.0, 0.0)
    for p in points:
        moved = (p[0] != last[0], p[1] != last[1])
        if all(moved) if both else any(moved):
            want.append(p)
            last = p
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in points],)], "p array<struct<lon:double,lat:double>>")
    for run in (1, 7, 256):
        assert [tuple(p) for p in df.select(routes.kept_points(F.col("p"), both, run).alias("k")).first().k] == want
