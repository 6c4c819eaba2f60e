"""The driver's tables seen as trips, steps, routes, lines and graphs.

Each view has a DataFrame form and, under the same name in ``SQL``, a DuckDB form.
All of them are row by row: no view groups, ranks or joins big tables, so a hot
key in a table does not make a hot task here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corridor.constants import CITY_ORDER
from corridor.sources.tables import spread

TRIP_PERIODS = [
    "1996-01-01 12:00:00", "1997-06-30 11:45:00", "1998-12-31 13:45:00",
    "2000-03-15 08:45:00", "2001-06-30 09:00:00",
]
EVENT_PERIODS = [
    "2024-01-01 12:00:00", "2024-01-08 11:45:00", "2024-01-16 13:45:00",
    "2024-01-22 08:45:00", "2024-01-29 09:00:00",
]
ERA_SPLIT = "2024-01-16"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _point(lon: str, lat: str) -> str:
    return f"named_struct('lon', cast({lon} as double), 'lat', cast({lat} as double))"


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as trips: OD from the supplier, poll slot and path from the other keys."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as k1", "l_linenumber as k2", "l_partkey as k3", "l_suppkey as k4",
        "cast(l_shipdate as date) as date",
        "cast(pmod(l_orderkey * 7 + l_partkey, 96) as int) as slot",
        "cast(l_suppkey % 30 as int) as od",
        "cast(l_quantity as int) * 61 - 61 as duration",
        "cast(floor(l_extendedprice) as int) as travelDis",
        "case when l_returnflag <> 'N' then l_partkey end as fid",
        "case when l_returnflag = 'A' and l_linestatus = 'F' then 'Humen bridge' "
        "when l_returnflag = 'A' then 'HZMB' "
        "when l_returnflag = 'R' and l_linestatus = 'F' then 'Nanshan bridge' end as bridge",
    )
    return rows.selectExpr(
        "k1", "k2", "k3", "k4", "date", "fid", "bridge", "duration", "travelDis", "od",
        "cast(((day(date) * 100 + slot div 4) * 100 + (slot % 4) * 15) * 1000 + od as bigint) as tripID",
        "cast(date as timestamp_ntz) + make_dt_interval(0, cast(slot div 4 as int), (slot % 4) * 15) as time",
        "slot / 4.0D as t",
        "try_divide(cast(travelDis as double), cast(duration as double)) as speed",
    )


def poi(spark: SparkSession, folder: str) -> DataFrame:
    """nation as the OD dimension: 25 pairs of different cities."""
    order = "array(" + ", ".join(f"'{c}'" for c in CITY_ORDER) + ")"
    return table(spark, folder, "nation").selectExpr(
        "n_nationkey as id",
        f"{order}[n_nationkey % 11] as o",
        f"{order}[(n_nationkey + n_nationkey div 11 + 1) % 11] as d",
        "113.0D + (n_nationkey % 11) * 0.1D as lon_0", "22.0D + (n_nationkey % 7) * 0.1D as lat_0",
        "113.5D + (n_nationkey % 5) * 0.1D as lon_1", "22.4D + (n_nationkey % 3) * 0.1D as lat_1",
    )


def od_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Trips with origin and destination names (unknown ODs dropped)."""
    names = poi(spark, folder).selectExpr("id as od", "o", "d")
    return trips(spark, folder).join(names, "od").withColumnRenamed("od", "OD")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """events as step rows of polls every 15 minutes; one type names two bridges, one none."""
    rows = table(spark, folder, "events").selectExpr(
        "event_id", "cast(ts as date) as date",
        "concat(date_format(ts, 'HH'), lpad(cast(minute(ts) div 15 * 15 as string), 2, '0')) as clock",
        "cast(user_id % 1000 as int) as OD",
        "case event_type when 'view' then '沿虎门大桥向西行驶' when 'click' then ' 驶入南沙大桥 ' "
        "when 'error' then '经港珠澳大桥转虎门大桥' when 'purchase' then '港珠澳大桥' else '左转' end as instruction",
        "case when event_id % 7 = 0 then null else concat('road ', event_id % 40) end as road",
        "cast(floor(value * 100) as int) as distance",
        "cast(event_id % 120 as int) as duration",
        "event_id % 50 as fid",
    )
    return rows.selectExpr(
        "*",
        "cast((cast(concat(day(date), clock) as bigint)) * 1000 + OD as string) as tripID",
        "cast(event_id % 12 as int) as stepID",
        "cast(date as timestamp_ntz) + make_dt_interval(0, cast(substr(clock, 1, 2) as int), cast(substr(clock, 3, 2) as int)) as timestamp",
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as lines of 32 vertices across the study area."""
    at = "cast(embedding[{}] as double)"
    return spread(table(spark, folder, "embeddings")).selectExpr(
        "vec_id as id",
        f"transform(sequence(0, 31), i -> {_point('113.5D + ' + at.format('2 * i'), '22.5D + ' + at.format('2 * i + 1'))}) as coords",
    )


def near_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding line three times: as it is, and moved a little each way."""
    moved = lines(spark, folder).selectExpr("id as vec", "coords", "explode(array(0, 1, -1)) as k")
    shifted = moved.selectExpr(
        "vec * 3 + k + 1 as id", "0.2D + (vec % 5) * 0.1D as freq",
        f"transform(coords, p -> {_point('p.lon + k * (vec % 9 + 1) * 1.0E-5D', 'p.lat + k * (vec % 9 + 1) * 1.0E-5D')}) as coords",
    )
    return shifted


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """part as short paths over a few shared nodes, so that segments repeat."""
    node = lambda k: _point(f"113.0D + ({k}) * 0.01D", f"22.0D + ({k}) * ({k}) * 0.001D")
    return spread(table(spark, folder, "part")).selectExpr(
        "p_partkey as fid", "p_brand as source",
        f"array({node('p_size % 10')}, {node('(p_size + p_partkey) % 10')}, "
        f"{node('length(p_name) % 10')}, {node('p_partkey % 10')}) as coords",
    )


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """orders as raw route answers: ``od, crawl, body`` with nested JSON text."""
    spot = "concat('113.', lpad(cast((k * 3 + {0}) % 50 as string), 2, '0'), ',22.', lpad(cast((k + {1}) % 40 as string), 2, '0'))"
    states = "array('畅通', '缓行', '拥堵', '非常拥堵', '未知', '')"
    tmcs = (
        "transform(filter(sequence(0, 2), j -> j < i % 3), j -> named_struct("
        "'lcode', cast(k as string), 'distance', cast(40 + j * 10 as string), "
        f"'status', {states}[cast((c + j) % 6 as int)], "
        f"'polyline', concat({spot.format('j', 'j')}, ';', {spot.format('j + 1', 'j + 1')})))"
    )
    steps_json = (
        "transform(sequence(0, cast(k % 3 as int)), i -> named_struct("
        "'instruction', concat('go ', i), 'orientation', 'W', "
        "'road', case when (k + i) % 4 = 0 then null else concat('road ', i) end, "
        "'distance', cast(100 * (i + 1) + c % 97 as string), 'duration', cast(10 * (i + 1) + c % 7 as string), "
        "'tolls', '0', 'toll_distance', '0', 'toll_road', '', 'action', 'left', 'assistant_action', '', "
        f"'polyline', concat({spot.format('i', 'i')}, ';', {spot.format('i', 'i + 1')}, ';', {spot.format('i + 1', 'i + 2')}), "
        f"'tmcs', {tmcs}))"
    )
    rows = spread(table(spark, folder, "orders")).selectExpr(
        "o_orderkey as k", "o_custkey as c", "cast(o_orderdate as date) as date"
    )
    return rows.selectExpr(
        "k", "date", "cast(k % 1000 as int) as od",
        "concat(date_format(date, 'dd'), lpad(cast(c % 96 div 4 as string), 2, '0'), lpad(cast(c % 4 * 15 as string), 2, '0')) as crawl",
        "to_json(named_struct('route', named_struct('paths', array(named_struct("
        "'distance', cast(500 + c % 1000 as string), 'duration', cast(c % 60 as string), 'strategy', '速度最快', "
        "'tolls', cast(c % 30 as string), 'toll_distance', cast(c % 400 as string), "
        f"'traffic_lights', cast(c % 5 as string), 'steps', {steps_json}))))) as body",
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as edges from supplier to part numbers, with repeats and hubs."""
    return table(spark, folder, "lineitem").selectExpr("l_suppkey as src", "l_partkey as dst")


def road_graph(spark: SparkSession, folder: str) -> DataFrame:
    """part as a road graph: runs of consecutive nodes with gaps, branches and merges."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey as src", "p_brand as source",
        "explode(filter(array(case when p_size % 5 <> 0 then p_partkey + 1 end, "
        "case when p_size % 11 = 0 then p_partkey + 13 end), x -> x is not null)) as dst",
    )


def roads(spark: SparkSession, folder: str) -> DataFrame:
    """Road ids of the road graph's edges; some edges have none."""
    return road_graph(spark, folder).selectExpr(
        "case when source = 'Brand#3' then -1 - src else src end as s", "dst as e", "src div 3 as rid"
    )


_DUCK_NODE = "struct_pack(lon := 113.0::DOUBLE + ({0}) * 0.01::DOUBLE, lat := 22.0::DOUBLE + ({0}) * ({0}) * 0.001::DOUBLE)"
_DUCK_ORDER = "[" + ", ".join(f"'{c}'" for c in CITY_ORDER) + "]"
_DUCK_SPOT = "'113.' || lpad(((k * 3 + {0}) % 50)::VARCHAR, 2, '0') || ',22.' || lpad(((k + {1}) % 40)::VARCHAR, 2, '0')"

SQL = {
    "trips_v": """
        SELECT k1, k2, k3, k4, date, fid, bridge, duration, travelDis, od,
            (((day(date) * 100 + slot // 4) * 100 + (slot % 4) * 15) * 1000 + od)::BIGINT AS tripID,
            date::TIMESTAMP + to_minutes((slot * 15)::INTEGER) AS time, slot / 4.0::DOUBLE AS t,
            CASE WHEN duration <> 0 THEN travelDis::DOUBLE / duration END AS speed
        FROM (SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
                l_shipdate::DATE AS date, ((l_orderkey * 7 + l_partkey) % 96)::INTEGER AS slot,
                (l_suppkey % 30)::INTEGER AS od, l_quantity::INTEGER * 61 - 61 AS duration,
                floor(l_extendedprice)::INTEGER AS travelDis,
                CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS fid,
                CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'Humen bridge'
                     WHEN l_returnflag = 'A' THEN 'HZMB'
                     WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Nanshan bridge' END AS bridge
              FROM lineitem)""",
    "poi_v": f"""
        SELECT n_nationkey AS id, ({_DUCK_ORDER})[n_nationkey % 11 + 1] AS o,
            ({_DUCK_ORDER})[(n_nationkey + n_nationkey // 11 + 1) % 11 + 1] AS d,
            113.0::DOUBLE + (n_nationkey % 11) * 0.1::DOUBLE AS lon_0, 22.0::DOUBLE + (n_nationkey % 7) * 0.1::DOUBLE AS lat_0,
            113.5::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS lon_1, 22.4::DOUBLE + (n_nationkey % 3) * 0.1::DOUBLE AS lat_1
        FROM nation""",
    "od_trips_v": "SELECT t.*, p.o, p.d FROM trips_v t JOIN poi_v p ON t.od = p.id",
    "steps_v": """
        SELECT *, (concat(day(date), clock)::BIGINT * 1000 + OD)::VARCHAR AS tripID, (event_id % 12)::INTEGER AS stepID,
            date::TIMESTAMP + to_minutes(clock[1:2]::INTEGER * 60 + clock[3:4]::INTEGER) AS timestamp
        FROM (SELECT event_id, ts::DATE AS date,
                strftime(ts, '%H') || lpad((minute(ts) // 15 * 15)::VARCHAR, 2, '0') AS clock,
                (user_id % 1000)::INTEGER AS OD,
                CASE event_type WHEN 'view' THEN '沿虎门大桥向西行驶' WHEN 'click' THEN ' 驶入南沙大桥 '
                    WHEN 'error' THEN '经港珠澳大桥转虎门大桥' WHEN 'purchase' THEN '港珠澳大桥' ELSE '左转' END AS instruction,
                CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'road ' || (event_id % 40) END AS road,
                floor(value * 100)::INTEGER AS distance, (event_id % 120)::INTEGER AS duration, event_id % 50 AS fid
              FROM events)""",
    "lines_v": """
        SELECT vec_id AS id, list_transform(range(0, 32), lambda i: struct_pack(
            lon := 113.5::DOUBLE + embedding[2 * i + 1]::DOUBLE, lat := 22.5::DOUBLE + embedding[2 * i + 2]::DOUBLE)) AS coords
        FROM embeddings""",
    "near_v": """
        SELECT id * 3 + k + 1 AS id, 0.2::DOUBLE + (id % 5) * 0.1::DOUBLE AS freq,
            list_transform(coords, lambda p: struct_pack(
                lon := p.lon + k * (id % 9 + 1) * 1e-5::DOUBLE, lat := p.lat + k * (id % 9 + 1) * 1e-5::DOUBLE)) AS coords
        FROM lines_v, (VALUES (0), (1), (-1)) moves(k)""",
    "paths_v": f"""
        SELECT p_partkey AS fid, p_brand AS source, [{_DUCK_NODE.format('p_size % 10')}, {_DUCK_NODE.format('(p_size + p_partkey) % 10')},
            {_DUCK_NODE.format('length(p_name) % 10')}, {_DUCK_NODE.format('p_partkey % 10')}] AS coords
        FROM part""",
    "answers_v": """
        SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS date, (o_orderkey % 1000)::INTEGER AS od,
            strftime(o_orderdate, '%d') || lpad((o_custkey % 96 // 4)::VARCHAR, 2, '0')
                || lpad((o_custkey % 4 * 15)::VARCHAR, 2, '0') AS crawl
        FROM orders""",
    "answer_steps_v": f"""
        SELECT *, 100 * (i + 1) + c % 97 AS distance, 10 * (i + 1) + c % 7 AS duration,
            CASE WHEN (k + i) % 4 = 0 THEN ' ' ELSE 'road ' || i END AS road,
            {_DUCK_SPOT.format('i', 'i')} || ';' || {_DUCK_SPOT.format('i', 'i + 1')} || ';' || {_DUCK_SPOT.format('i + 1', 'i + 2')} AS polyline
        FROM (SELECT *, unnest(range(0, k % 3 + 1))::INTEGER AS i FROM answers_v)""",
    "answer_segments_v": f"""
        SELECT *, 40 + j * 10 AS metres,
            CASE (c + j) % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 0 END AS status,
            {_DUCK_SPOT.format('j', 'j')} || ';' || {_DUCK_SPOT.format('j + 1', 'j + 1')} AS line
        FROM (SELECT k, c, date, od, crawl, i, unnest(range(0, i % 3))::INTEGER AS j FROM answer_steps_v)""",
    "edges_v": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
    "degrees_v": """
        SELECT node, sum(i)::BIGINT AS indegree, sum(o)::BIGINT AS outdegree
        FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges_v UNION ALL SELECT src, 0, 1 FROM edges_v) GROUP BY node""",
    "road_graph_v": """
        SELECT p_partkey AS src, p_partkey + 1 AS dst, p_brand AS source FROM part WHERE p_size % 5 <> 0
        UNION SELECT p_partkey, p_partkey + 13, p_brand FROM part WHERE p_size % 11 = 0""",
}

_NEEDS = {
    "od_trips_v": ["trips_v", "poi_v"], "near_v": ["lines_v"], "answer_steps_v": ["answers_v"],
    "answer_segments_v": ["answer_steps_v"], "degrees_v": ["edges_v"],
}


def with_views(*names: str, recursive: bool = False, more: str = "") -> str:
    """A WITH clause of the named views and what they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({SQL[name]})" for name in ordered] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def stamp(column: str) -> str:
    """Timestamp text in Spark SQL."""
    return f"date_format({column}, 'yyyy-MM-dd HH:mm:ss')"


def duck_stamp(column: str) -> str:
    """Timestamp text in DuckDB."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def duck_degree(value: str) -> str:
    """Degree text in DuckDB: six decimals, no trailing zeros."""
    return f"rtrim(rtrim(round_even({value}, 6)::DECIMAL(12,6)::VARCHAR, '0'), '.')"


def duck_wkt(coords: str) -> str:
    pair = f"{duck_degree('p.lon')} || ' ' || {duck_degree('p.lat')}"
    return f"'LINESTRING (' || array_to_string(list_transform({coords}, lambda p: {pair}), ', ') || ')'"


def duck_period(ts: str, bounds: list[str], outside: str) -> str:
    parts = [
        f"WHEN {ts} > TIMESTAMP '{low}' AND {ts} <= TIMESTAMP '{high}' THEN {n}"
        for n, (low, high) in enumerate(zip(bounds, bounds[1:]), start=1)
    ]
    return f"(CASE {' '.join(parts)} ELSE {outside} END)::INTEGER"
