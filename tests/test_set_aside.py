"""Rows that a parser leaves out come back in a frame of their own; joins by id keep hot and null ids apart."""

import json

from pyspark.sql import functions as F

from corridor import schemas
from corridor.operators import frames, paths
from corridor.plans import jobs
from corridor.scratch import checkpoint
from corridor.sources import lines, routes
from tests.conftest import line


def test_answers_are_kept_or_explained(spark):
    path = {"distance": "1", "duration": "2", "steps": []}
    bodies = [
        json.dumps({"route": {"paths": [path]}}), json.dumps({"route": {"paths": []}}), json.dumps({"status": "0"}),
        json.dumps({"route": None}), json.dumps({"route": {"paths": [None]}}), "", "  ", None, "{", '{"route": {"paths": [{"dist', "[1, 2]", "7",
        json.dumps({"route": {"paths": [path]}}) + "}",
    ]
    raw = spark.createDataFrame([(i, 1, "060630", b) for i, b in enumerate(bodies)], "k int, od int, crawl string, body string")
    kept = [r.k for r in routes.parse_routes(raw).collect()]
    aside = {r.k: r.reason for r in routes.unanswered(raw).collect()}
    assert sorted(kept + list(aside)) == list(range(len(bodies)))
    assert 0 in kept
    assert [aside[k] for k in (1, 2, 3, 5, 6, 7, 8)] == ["no path", "no route", "no route", "empty", "empty", "empty", "not json"]
    assert routes.unanswered(raw.where("false")).count() == 0


def test_damaged_lines_are_set_aside_whole(spark):
    texts = ["1,2;3,4", "1,2;x,4;5,6", "1,2;;3,4", "1;2,3", "", None, "1,2,9;3,4"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    good, aside = lines.split_lines(df, "line")
    assert {r.id: len(r.coords) for r in good.collect()} == {0: 2, 6: 2}
    assert {r.id: r.bad_points for r in aside.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: None}
    assert aside.columns == ["id", "line", "bad_points"]


def test_lines_by_hot_and_null_ids(spark):
    """Half the ids null, a third of the rest equal, adaptive execution off: the result is the plain join's."""
    rows = spark.range(6000).select(
        F.col("id").alias("n"), F.expr("case when id % 2 = 0 then null when id % 3 = 0 then 5 else id % 400 end").alias("fid")
    )
    dictionary = checkpoint(paths.upsert(paths.empty(spark), spark.createDataFrame(
        [(i, line((i, 1), (i + 1, 2))) for i in range(150)], f"id long, coords {schemas.COORDS}")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for how in ("inner", "left"):
            got = paths.with_lines(rows, dictionary, ("_wkt",), how).select("n", "fid", "_wkt")
            plain = rows.join(dictionary.select("fid", "_wkt"), "fid", how).select("n", "fid", "_wkt")
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_unmapped_and_semi_distinct(spark):
    dictionary = paths.upsert(paths.empty(spark), spark.createDataFrame([(0, line((1, 1), (2, 2)))], f"id long, coords {schemas.COORDS}"))
    freq = spark.createDataFrame([(0, 7, 2, 4), (9, 7, 2, 3), (None, 7, 2, 2), (9, 8, 2, 1)], "fid long, OD int, period int, nums long")
    assert sorted(((r.fid, r.freq) for r in jobs.unmapped(freq, dictionary, 7, 2).collect()), key=str) == [(9, 3.0), (None, 2.0)]
    assert [(r.fid, r.freq) for r in jobs.od_heat_map(freq, dictionary, 7, 2).collect()] == [(0, 4.0)]
    found = frames.semi_distinct(freq.select("OD", "fid"), freq.where("OD = 8 or fid is null"), ["fid"])
    assert found.columns == ["OD", "fid"] and sorted(map(tuple, found.collect())) == [(7, 9), (8, 9)]
