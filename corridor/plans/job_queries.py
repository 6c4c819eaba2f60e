"""Queries that run the composite jobs from raw answers to reports."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corridor.functions import geometry as G
from corridor.functions import ids
from corridor.operators import heat, paths, spatial, trips
from corridor.operators.paths import PathStore
from corridor.plans import jobs
from corridor.plans import views as V
from corridor.plans.geometry_queries import SPATIAL, duck_groups, duck_merged, duck_near
from corridor.plans.registry import query
from corridor.plans.step_queries import CLOCK, _merged
from corridor.plans.trip_queries import KEYS, K
from corridor.scratch import new_path, stored
from corridor.sources import routes
from corridor.streaming import day_batches

POINT = "split_part(polyline, ';', p)"
TEXT = f"""string_agg({V.duck_degree(f"split_part({POINT}, ',', 1)::DOUBLE")} || ' ' ||
    {V.duck_degree(f"split_part({POINT}, ',', 2)::DOUBLE")}, ', ' ORDER BY i, p)"""
CRAWL_T = "(crawl[3:4]::INTEGER + crawl[5:6]::INTEGER / 60.0::DOUBLE)"


@query(
    "job_trip_day",
    V.with_views("answer_steps_v", more=f"""drawn AS (
        SELECT k, 'LINESTRING (' || {TEXT} || ')' AS wkt FROM (SELECT *, unnest([1, 2, 3]) AS p FROM answer_steps_v) GROUP BY k)""")
    + f"""SELECT k AS row_idx, crawl::BIGINT * 1000 + od AS tripID, od AS OD, round({CRAWL_T}, 6) AS t, (c % 60)::INTEGER AS duration,
        (500 + c % 1000)::INTEGER AS travelDis, (c % 5)::INTEGER AS traffic_lights, wkt FROM answers_v JOIN drawn USING (k)""",
)
def job_trip_day(spark, folder):
    parsed = stored(routes.parse_routes(V.routes(spark, folder)).withColumnRenamed("k", "row_idx"), "answers")
    csv = routes.trip_rows(parsed, keep=("date", "row_idx"))
    features = parsed.select(
        "date", "row_idx", F.col("od").cast("string").alias("tripID"), "path.duration", F.col("path.distance").alias("travelDis"),
        F.col("path.toll_distance").alias("toll_distan"), F.col("path.traffic_lights").alias("traffic_lig"),
        F.flatten(F.transform("path.steps", lambda s: G.parse_polyline(s["polyline"]))).alias("coords"),
    )
    store = PathStore(spark, new_path(spark, "paths"))
    day = jobs.trip_day(features, csv, store)
    named = paths.with_lines(day, store.load()).withColumnRenamed("_wkt", "wkt")
    return named.select("row_idx", "tripID", "OD", F.round("t", 6).alias("t"), "duration", "travelDis", "traffic_lights", "wkt")


def _step_files(spark, folder):
    parsed = routes.parse_routes(V.routes(spark, folder))
    rows = stored(routes.step_rows(parsed, keep=("k", "date")).withColumn("row_idx", F.expr("k * 10 + step_id")), "steps")
    features = rows.selectExpr("date", "row_idx", "ID", "cast(OD as string) as tripID", "distance", "duration", "tolls", "coords")
    csv = rows.select(
        "date", "row_idx", "tripID", "instruction", "orientation", "road", "distance", "tolls", "toll_distance",
        "toll_road", "duration", "action", "assistant_action",
    )
    return features, csv


@query(
    "job_steps",
    V.with_views("answer_steps_v", more=f"""drawn AS (
        SELECT k, i, 'LINESTRING (' || {TEXT} || ')' AS wkt FROM (SELECT *, unnest([1, 2, 3]) AS p FROM answer_steps_v) GROUP BY k, i)""")
    + f"""SELECT crawl || (od * 100 + i) AS tripID, od AS OD, i AS step_id, road, distance::INTEGER AS distance, duration::INTEGER AS duration,
        date::VARCHAR AS day, round({CRAWL_T}, 6) AS t, wkt FROM answer_steps_v JOIN drawn USING (k, i)""",
)
def job_steps(spark, folder):
    features, csv = _step_files(spark, folder)
    store = PathStore(spark, new_path(spark, "paths"))
    rows = jobs.step_day(features, csv, store)
    named = paths.with_lines(rows, store.load()).withColumnRenamed("_wkt", "wkt")
    return named.select(
        "tripID", "OD", "step_id", "road", "distance", "duration", F.col("date").cast("string").alias("day"), F.round("t", 6).alias("t"), "wkt"
    )


@query(
    "job_steps_p12",
    V.with_views("answer_steps_v") + f"""SELECT (crawl::BIGINT * 1000 + od)::VARCHAR AS tripID, od AS OD, round({CRAWL_T}, 6) AS t, road,
        (k * 10 + i - min(k * 10 + i) OVER (PARTITION BY date, od, crawl))::INTEGER AS step_id, NULL::BIGINT AS fid FROM answer_steps_v""",
)
def job_steps_p12(spark, folder):
    parsed = routes.parse_routes(V.routes(spark, folder))
    rows = stored(routes.step_rows(parsed, keep=("k", "date", "crawl")), "steps")
    numeric = (F.col("crawl").cast("bigint") * 1000 + F.col("OD")).cast("string")
    csv = rows.withColumns({"row_idx": F.expr("k * 10 + step_id"), "tripID": numeric}).drop("ID", "OD", "step_id", "coords", "k", "crawl")
    found = jobs.step_day_without_lines(csv)
    return found.select("tripID", "OD", F.round("t", 6).alias("t"), "road", "step_id", "fid")


@query(
    "job_segments",
    V.with_views("answer_segments_v", more=f"""drawn AS (
        SELECT k, i, j, 'LINESTRING (' || {TEXT} || ')' AS wkt
        FROM (SELECT k, i, j, line AS polyline, unnest([1, 2]) AS p FROM answer_segments_v) GROUP BY k, i, j)""")
    + """SELECT (crawl || (od * 10000 + i * 100 + j))::BIGINT AS lineID, od::BIGINT AS tripID, metres::INTEGER AS distance, status, wkt
        FROM answer_segments_v JOIN drawn USING (k, i, j)""",
)
def job_segments(spark, folder):
    segments = routes.segment_rows(routes.parse_routes(V.routes(spark, folder)))
    features = stored(segments.select("lineID", "tripID", "distance", "status", "coords"), "segments")
    store = PathStore(spark, new_path(spark, "paths"))
    rows = jobs.segment_day(features, store)
    named = paths.with_lines(rows.withColumnRenamed("path_id", "fid"), store.load()).withColumnRenamed("_wkt", "wkt")
    return named.selectExpr(
        "cast(lineID as bigint) as lineID", "cast(tripID as bigint) as tripID", "cast(distance as int) as distance",
        "cast(status as int) as status", "wkt",
    )


@query(
    "job_enrich",
    SPATIAL.rstrip() + f""", poi_v AS ({V.SQL['poi_v']}), trips_v AS ({V.SQL['trips_v']}), od_trips_v AS ({V.SQL['od_trips_v']})
        SELECT {K}, od AS OD, o, d, bridge, period, round(max(speed) OVER (PARTITION BY od) / speed, 4) AS ci FROM (
            SELECT t.* EXCLUDE (bridge, speed), h.bridge, speed::FLOAT::DOUBLE AS speed,
                {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} AS period FROM od_trips_v t LEFT JOIN hits h ON t.fid = h.id)""",
)
def job_enrich(spark, folder):
    store = V.trips(spark, folder).drop("bridge", "od").withColumns({"OD": F.lit(0), "period": F.lit(0)})
    dictionary = V.lines(spark, folder).withColumnRenamed("id", "fid")
    poi = V.poi(spark, folder).withColumnRenamed("id", "OD")
    found = jobs.enrich_trips(store, dictionary, spatial.bridge_polygons(spark), poi, V.TRIP_PERIODS)
    return found.select(*KEYS, "OD", "o", "d", "bridge", "period", F.round("ci", 4).alias("ci"))


HEAT = f"""used AS (
        SELECT fid, count(*) AS nums FROM trips_v WHERE od = 7 AND {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} = 2 AND fid IS NOT NULL GROUP BY fid),
    drawn AS (SELECT n.id, coords, nums::DOUBLE AS freq FROM near_v n JOIN used u ON n.id = u.fid),
    pairs AS ({duck_near('drawn', 'id')}), {duck_groups('pairs')}"""


@query(
    "job_heat_map",
    V.with_views("near_v", "trips_v", recursive=True, more=HEAT)
    + f"SELECT id AS fid, merged_freq AS freq, members FROM ({duck_merged('drawn', None, 'id', 'id')})",
)
def job_heat_map(spark, folder):
    rows = trips.add_period(V.trips(spark, folder), "time", V.TRIP_PERIODS).withColumnRenamed("od", "OD")
    freq = heat.path_use(rows, ["OD", "period"]).withColumnRenamed("used", "nums")
    dictionary = V.near_lines(spark, folder).select(F.col("id").alias("fid"), "coords", G.line_wkt(F.col("coords")).alias("_wkt"))
    return jobs.od_heat_map(freq, dictionary, 7, 2).select("fid", "freq", "members")


@query(
    "job_heat_map_rest",
    V.with_views("paths_v", "trips_v", more=f"""used AS (
        SELECT fid, count(*) AS nums FROM trips_v WHERE od = 7 AND {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} = 2 AND fid IS NOT NULL GROUP BY fid)""")
    + "SELECT fid, nums::DOUBLE AS freq FROM used WHERE fid NOT IN (SELECT fid FROM paths_v WHERE source <> 'Brand#3')",
)
def job_heat_map_rest(spark, folder):
    rows = trips.add_period(V.trips(spark, folder), "time", V.TRIP_PERIODS).withColumnRenamed("od", "OD")
    freq = heat.path_use(rows, ["OD", "period"]).withColumnRenamed("used", "nums")
    known = V.paths(spark, folder).where("source <> 'Brand#3'").withColumn("_wkt", G.line_wkt(F.col("coords")))
    return jobs.unmapped(freq, known, 7, 2)


@query(
    "job_bridge_steps",
    SPATIAL.rstrip() + f""", steps_v AS ({V.SQL['steps_v']})
        SELECT DISTINCT fid, OD, road, instruction FROM steps_v WHERE fid IN (SELECT id FROM hits)""",
)
def job_bridge_steps(spark, folder):
    dictionary = V.lines(spark, folder).withColumnRenamed("id", "fid")
    rows = V.steps(spark, folder).select("fid", "OD", "road", "instruction")
    return jobs.steps_on_bridges(rows, dictionary, spatial.bridge_polygons(spark))


@query(
    "job_batch_days",
    V.with_views("steps_v") + f"""SELECT event_id, concat(day(date), clock, OD, lpad(stepID::VARCHAR, 2, '0')) AS tripID, OD::VARCHAR AS OD,
        date::VARCHAR AS day, round({CLOCK}, 6) AS t, stepID, road FROM steps_v""",
)
def job_batch_days(spark, folder):
    """Day files in two arrivals, the second one late for days that are done; the first run is lost after a write and repeated."""
    rows = _merged(spark, folder).withColumn("file", F.expr("concat('trip_step_', date % 1000000, '.csv')"))
    lines = rows.select("event_id", "file", F.concat_ws(",", "event_id", "ID", "tripID", F.coalesce("road", F.lit("")), "fid").alias("value"))
    landing, out, marks = (new_path(spark, name) for name in ("landing", "days", "marks"))

    def arrive(part, condition):
        lines.where(condition).drop("event_id").hint("rebalance", F.col("file")).write.partitionBy("file").text(f"{landing}/{part}")

    def run(after_write=None):
        jobs.batch_days(
            spark, landing, out, marks, "event_id bigint, ID string, tripID string, road string, fid bigint", after_write,
            glob="*.txt", date=lambda file: ids.date_from_file_name(F.regexp_extract(file, "file=([^/]+)/", 1)), files_per_batch=64,
        )

    def lose(number):
        raise ConnectionError("the driver is lost before the batch counts as done")

    arrive("first", "event_id % 3 <> 0")
    try:
        run(lose)
    except StreamingQueryException:
        pass
    run()
    arrive("second", "event_id % 3 = 0")
    run()
    done = spark.read.parquet(f"{out}/rows")
    return done.select(
        "event_id", "tripID", F.col("OD").cast("string").alias("OD"), F.col("date").cast("string").alias("day"), F.round("t", 6).alias("t"), "stepID", "road"
    )
