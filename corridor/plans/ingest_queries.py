"""Queries on sources and sinks: scans, file dates, bad rows, routes, round trips, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor import scratch
from corridor.functions import geometry as G
from corridor.functions import ids
from corridor.operators import frames
from corridor.plans import jobs
from corridor.plans import views as V
from corridor.plans.registry import query
from corridor.plans.step_queries import BRIDGE, CLOCK, NAME, _merged
from corridor.sources import lines, routes, sinks, tables
from corridor.streaming import bridge_speed


@query("scan_view", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def scan_view(spark, folder):
    tables.register_views(spark, {"corridor_events": f"{folder}/events.parquet"})
    return spark.sql("SELECT event_type, count(*) AS n FROM corridor_events GROUP BY event_type")


@query(
    "date_from_filename",
    """SELECT DISTINCT 'trip_step_' || strftime(l_shipdate + INTERVAL 20 YEARS, '%y%m%d') || '.csv' AS file,
        ((l_shipdate + INTERVAL 20 YEARS)::DATE)::VARCHAR AS day FROM lineitem""",
)
def date_from_filename(spark, folder):
    files = V.table(spark, folder, "lineitem").selectExpr(
        "concat('trip_step_', date_format(add_months(l_shipdate, 240), 'yyMMdd'), '.csv') as file"
    ).distinct()
    return files.select("file", ids.date_from_file_name(F.col("file")).cast("string").alias("day"))


@query(
    "unvisited_anti",
    "SELECT DISTINCT (o_orderdate::DATE)::VARCHAR AS day FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem)",
)
def unvisited_anti(spark, folder):
    arrived = V.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    done = V.table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return tables.unvisited_days(arrived, done).select(F.col("date").cast("string").alias("day"))


@query(
    "ingest_quarantine",
    """SELECT event_id, event_type, CASE WHEN event_type <> 'signup' THEN floor(value)::INTEGER END AS value, event_type = 'signup' AS bad FROM events""",
)
def ingest_quarantine(spark, folder):
    text = V.table(spark, folder, "events").selectExpr(
        "concat_ws(',', event_id, event_type, case when event_type = 'signup' then 'n/a' else cast(floor(value) as string) end) as line"
    )
    path = scratch.new_path(spark, "landing")
    text.write.text(path)
    good, bad = tables.read_quarantine(spark, path, "event_id bigint, event_type string, value int")
    parts = F.split(tables.CORRUPT, ",")
    held = bad.select(
        parts[0].cast("bigint").alias("event_id"), parts[1].alias("event_type"), F.lit(None).cast("int").alias("value"), F.lit(True).alias("bad")
    )
    return good.withColumn("bad", F.lit(False)).unionByName(held)


@query(
    "row_index",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER () - 1 AS row_idx FROM lineitem",
)
def row_index(spark, folder):
    rows = tables.parquet_row_index(V.table(spark, folder, "lineitem"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_idx")


def _siblings(spark, folder):
    """One file seen as two sibling files that share row positions, but for the rows of part 5."""
    rows = tables.parquet_row_index(V.table(spark, folder, "lineitem")).withColumn("file", F.col("_metadata.file_name"))
    left = rows.selectExpr("file", "row_idx", "l_orderkey", "cast(l_quantity as int) as duration", "l_linenumber as distance")
    right = rows.selectExpr(
        "file", "case when l_partkey = 5 then -1 - row_idx else row_idx end as row_idx", "l_orderkey", "l_partkey", "l_suppkey",
        "cast(l_quantity as int) + case when l_linenumber = 7 then 1 when l_linenumber = 6 then -1 else 0 end as duration",
        "l_linenumber as distance",
    )
    return left, right


@query("positional_join", "SELECT l_orderkey, l_linenumber AS distance, l_partkey, l_suppkey FROM lineitem")
def positional_join(spark, folder):
    rows = tables.parquet_row_index(V.table(spark, folder, "lineitem")).withColumn("file", F.col("_metadata.file_name"))
    left = rows.selectExpr("file", "row_idx", "l_orderkey", "l_linenumber as distance")
    right = rows.select("file", "row_idx", "l_orderkey", "l_partkey", "l_suppkey")
    return frames.positional_join(left, right, ["file", "row_idx"]).select("l_orderkey", "distance", "l_partkey", "l_suppkey")


@query(
    "consistency_check",
    """SELECT count(*) AS rows_left, count(*) AS rows_right, 2 * count(*) FILTER (l_partkey = 5) AS rows_unmatched,
        count(*) FILTER (l_partkey <> 5 AND l_linenumber IN (6, 7)) AS duration_differs, 0::BIGINT AS distance_differs FROM lineitem""",
)
def consistency_check(spark, folder):
    left, right = _siblings(spark, folder)
    return frames.consistency(left, right, ["file", "row_idx"], ["duration", "distance"])


PATH_TEXT = "array_join(transform(coords, p -> concat(p.lon, ',', p.lat)), ';') as line"


@query("line_ingest", V.with_views("paths_v") + f"SELECT fid, {V.duck_wkt('coords')} AS wkt FROM paths_v")
def line_ingest(spark, folder):
    features = V.paths(spark, folder).selectExpr("fid", PATH_TEXT, "'x' as road")
    found = lines.ingest_lines(features, "line", drop=("road",))
    return found.select("fid", G.line_wkt(F.col("coords")).alias("wkt"))


DAMAGE = "CASE WHEN fid % 7 = 1 THEN replace({line}, '113.0', '113,x') WHEN fid % 11 = 2 THEN NULL WHEN fid % 13 = 3 THEN {line} || ';' ELSE {line} END"


@query(
    "line_quarantine",
    V.with_views("paths_v", more=f"""texts AS (
        SELECT fid, array_to_string(list_transform(coords, lambda p: p.lon || ',' || p.lat), ';') AS line FROM paths_v),
        damaged AS (SELECT fid, {DAMAGE.format(line='line')} AS line FROM texts),
        counted AS (SELECT *, len(list_filter(string_split(line, ';'), lambda n: TRY_CAST(split_part(n, ',', 1) AS DOUBLE) IS NULL
            OR TRY_CAST(split_part(n, ',', 2) AS DOUBLE) IS NULL))::INTEGER AS bad FROM damaged)""")
    + "SELECT fid, bad AS bad_points, bad = 0 IS TRUE AS kept FROM counted",
)
def line_quarantine(spark, folder):
    """Lines with damaged points are set aside whole; all lines come back, kept or not."""
    text = V.paths(spark, folder).selectExpr("fid", PATH_TEXT)
    damaged = text.withColumn("line", F.expr(DAMAGE.format(line="line")))
    good, aside = lines.split_lines(damaged, "line")
    kept = good.select("fid", F.lit(0).alias("bad_points"), F.lit(True).alias("kept"))
    return kept.unionByName(aside.select("fid", "bad_points", F.lit(False).alias("kept")))


BODIES = {
    0: "''", 1: "substr(body, 1, 40)", 2: """'{"status":"0","info":"INVALID_KEY"}'""", 3: """'{"route":{"paths":[]}}'""", 4: "NULL", 5: "'[1, 2'",
}


@query(
    "route_unanswered",
    V.with_views("answers_v") + """SELECT k, ['empty', 'not json', 'no route', 'no path', 'empty', 'not json'][k % 9 + 1] AS reason
        FROM answers_v WHERE k % 9 < 6""",
)
def route_unanswered(spark, folder):
    """Answers that bear no path, with the reason; the others are what ``parse_routes`` keeps."""
    cases = " ".join(f"WHEN k % 9 = {k} THEN {text}" for k, text in BODIES.items())
    raw = V.routes(spark, folder).withColumn("body", F.expr(f"CASE {cases} ELSE body END"))
    return routes.unanswered(raw).select("k", "reason")


@query(
    "polyline_parse",
    V.with_views("paths_v") + """SELECT fid, (pos - 1)::INTEGER AS pos, coords[pos].lon AS lon, coords[pos].lat AS lat
        FROM (SELECT *, unnest(range(1, len(coords) + 1)) AS pos FROM paths_v)""",
)
def polyline_parse(spark, folder):
    text = V.paths(spark, folder).selectExpr("fid", PATH_TEXT)
    points = text.select("fid", F.posexplode(G.parse_polyline(F.col("line"))).alias("pos", "p"))
    return points.select("fid", "pos", "p.lon", "p.lat")


@query("geojson_features", V.with_views("paths_v") + """SELECT '{"type":"Feature","properties":{"fid":' || fid || ',"sizes":"[1, 2]"},"geometry":{"type":"LineString","coordinates":['
        || array_to_string(list_transform(coords, lambda p: '[' || p.lon || ',' || p.lat || ']'), ',') || ']}}' AS feature FROM paths_v""")
def geojson_features(spark, folder):
    rows = V.paths(spark, folder).selectExpr("fid", "array(1, 2) as sizes", "coords")
    return sinks.geojson_features(rows, list_columns=("sizes",))


SUMS = ", ".join(
    f"round(coalesce(sum(metres) FILTER (status = {code}), 0)::DOUBLE / (500 + c % 1000), 6) AS {name}"
    for name, code in routes.STATUS_COLUMNS.items()
)


@query(
    "route_trip",
    V.with_views("answer_segments_v") + f"""SELECT a.k, crawl::BIGINT * 1000 + a.od AS tripID, a.od AS OD, (c % 60)::INTEGER AS duration,
        (500 + c % 1000)::DOUBLE AS travelDis, CASE WHEN c % 60 > 0 THEN round((500 + c % 1000) / (c % 60), 6) END AS speed,
        (c % 30)::INTEGER AS tolls, (c % 5)::INTEGER AS traffic_lights, {SUMS.replace('c % 1000', 'a.c % 1000')}
        FROM answers_v a LEFT JOIN (SELECT k, status, metres FROM answer_segments_v) s ON a.k = s.k GROUP BY a.k, a.c, a.od, a.crawl""",
)
def route_trip(spark, folder):
    rows = routes.trip_rows(routes.parse_routes(V.routes(spark, folder)), digits=6, keep=("k",))
    return rows.withColumn("speed", F.round("speed", 6)).select(
        "k", "tripID", "OD", "duration", "travelDis", "speed", "tolls", "traffic_lights", *routes.STATUS_COLUMNS
    )


@query(
    "route_steps",
    V.with_views("answer_steps_v") + """SELECT k, od || '_' || i AS tripID, crawl || (od * 100 + i) AS ID, od AS OD, i AS step_id, road,
        distance::INTEGER AS distance, duration::INTEGER AS duration, 3 AS vertices FROM answer_steps_v""",
)
def route_steps(spark, folder):
    rows = routes.step_rows(routes.parse_routes(V.routes(spark, folder)), keep=("k",))
    return rows.select("k", "tripID", "ID", "OD", "step_id", "road", "distance", "duration", F.size("coords").alias("vertices"))


@query(
    "route_segments",
    V.with_views("answer_segments_v") + """SELECT crawl || (od * 10000 + i * 100 + j) AS lineID, od AS tripID, k::VARCHAR AS lcode,
        metres::INTEGER AS distance, status, line FROM answer_segments_v""",
)
def route_segments(spark, folder):
    rows = routes.segment_rows(routes.parse_routes(V.routes(spark, folder)))
    text = F.array_join(
        F.transform("coords", lambda p: F.format_string("%.2f,%.2f", p["lon"], p["lat"])), ";"
    )
    return rows.select("lineID", "tripID", "lcode", "distance", "status", text.alias("line"))


@query(
    "route_points",
    V.with_views(
        "answer_steps_v", recursive=True,
        more="""points AS (
            SELECT k, crawl, od, i * 3 + p AS pos, split_part(split_part(polyline, ';', p + 1), ',', 1)::DOUBLE AS lon,
                split_part(split_part(polyline, ';', p + 1), ',', 2)::DOUBLE AS lat
            FROM (SELECT *, unnest([0, 1, 2]) AS p FROM answer_steps_v)),
        walk AS (
            SELECT k, crawl, od, -1 AS pos, 0.0::DOUBLE AS lon, 0.0::DOUBLE AS lat, -1 AS node, false AS kept FROM answers_v
            UNION ALL
            SELECT p.k, p.crawl, p.od, p.pos,
                CASE WHEN p.lon <> w.lon AND p.lat <> w.lat THEN p.lon ELSE w.lon END,
                CASE WHEN p.lon <> w.lon AND p.lat <> w.lat THEN p.lat ELSE w.lat END,
                CASE WHEN p.lon <> w.lon AND p.lat <> w.lat THEN w.node + 1 ELSE w.node END,
                p.lon <> w.lon AND p.lat <> w.lat
            FROM walk w JOIN points p ON p.k = w.k AND p.pos = w.pos + 1)""",
    ) + "SELECT crawl::BIGINT * 1000 + od AS tripID, node::INTEGER AS nodeID, lon, lat FROM walk WHERE kept",
)
def route_points(spark, folder):
    return routes.point_rows(routes.parse_routes(V.routes(spark, folder)))


@query(
    "parquet_roundtrip",
    V.with_views("steps_v") + f"""SELECT date::VARCHAR AS day, OD::VARCHAR AS OD, count(*) AS n, min(stepID) AS first_step,
        round(max({CLOCK}), 6) AS last_t FROM steps_v GROUP BY date, OD""",
)
def parquet_roundtrip(spark, folder):
    stored = jobs.steps_to_parquet(_merged(spark, folder), scratch.new_path(spark, "steps"))
    return stored.groupBy(F.col("date").cast("string").alias("day"), "OD").agg(
        F.count(F.lit(1)).alias("n"), F.min("stepID").alias("first_step"), F.round(F.max("t"), 6).alias("last_t")
    )


def _landing_stream(spark, folder):
    """The same answers as they arrive."""
    path = f"{folder}/events.parquet"
    arriving = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return _answers(arriving)


def _answers(events):
    """events as one-step route answers with their poll time."""
    return events.selectExpr(
        "ts as polled_at", "cast(user_id % 1000 as int) as od", "date_format(ts, 'ddHHmm') as crawl",
        "to_json(named_struct('route', named_struct('paths', array(named_struct('distance', '1', 'duration', '1', 'steps', array(named_struct("
        "'instruction', case event_type when 'view' then '沿虎门大桥向西行驶' when 'click' then ' 驶入南沙大桥 ' "
        "when 'error' then '经港珠澳大桥转虎门大桥' when 'purchase' then '港珠澳大桥' else '左转' end, "
        "'distance', cast(cast(floor(value * 100) as int) as string), 'duration', cast(event_id % 120 as string), "
        "'polyline', '113.0,22.0;113.1,22.1'))))))) as body",
    )


@query(
    "stream_bridge_speed",
    V.with_views("steps_v") + f"""SELECT {V.duck_stamp('time_bucket(INTERVAL 15 MINUTES, timestamp)')} AS window_start, {NAME} AS bridge,
        round(avg(CASE WHEN duration <> 0 THEN distance::DOUBLE / duration * 3.6::DOUBLE END), 6) AS avg_speed,
        count(CASE WHEN duration <> 0 THEN 1 END) AS steps
        FROM (SELECT *, {BRIDGE} AS bridge FROM steps_v)
        WHERE bridge > 0 GROUP BY ALL""",
)
def stream_bridge_speed(spark, folder):
    windows = bridge_speed.windowed_speed(bridge_speed.step_stream(_landing_stream(spark, folder)), "polled_at")
    path, marks = scratch.new_path(spark, "windows"), scratch.new_path(spark, "stream")
    bridge_speed.run_available(windows, path, marks)
    arrived = bridge_speed.step_stream(_answers(V.table(spark, folder, "events")))
    return bridge_speed.with_open_windows(spark.read.schema(windows.schema).parquet(path), arrived, "polled_at").selectExpr(
        f"{V.stamp('window_start')} as window_start", "bridge", "round(avg_speed, 6) as avg_speed", "steps"
    )
