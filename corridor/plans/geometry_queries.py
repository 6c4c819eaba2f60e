"""Queries on lines: keys, lengths, datums, dictionary, spatial joins, heat maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corridor.constants import BRIDGE_NAMES, BRIDGE_RINGS
from corridor.functions import datum
from corridor.functions import geometry as G
from corridor.operators import frames, graph, heat, paths, spatial
from corridor.plans import views as V
from corridor.plans.registry import query
from corridor.scratch import new_path
from corridor.sources import routes

WKT = V.duck_wkt("coords")


@query("wkt_key", V.with_views("paths_v") + f"SELECT {WKT} AS wkt, count(*) AS copies FROM paths_v GROUP BY {WKT}")
def wkt_key(spark, folder):
    keyed = paths.keyed(V.paths(spark, folder))
    grouped = keyed.groupBy(*paths.KEY).agg(F.any_value("coords").alias("coords"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(G.line_wkt(F.col("coords")).alias("wkt"), "copies")


def _duck_point(p):
    return f"'POINT (' || {V.duck_degree(p + '.lon')} || ' ' || {V.duck_degree(p + '.lat')} || ')'"


@query("endpoints", V.with_views("lines_v") + f"SELECT id, {_duck_point('coords[1]')} AS \"start\", {_duck_point('coords[-1]')} AS \"end\" FROM lines_v")
def endpoints(spark, folder):
    return graph.endpoints(V.lines(spark, folder)).select("id", "start", "end")


@query(
    "segments",
    V.with_views("lines_v") + """SELECT id, coords[i].lon AS a_lon, coords[i].lat AS a_lat, coords[i + 1].lon AS b_lon, coords[i + 1].lat AS b_lat
        FROM (SELECT *, unnest(range(1, len(coords))) AS i FROM lines_v)""",
)
def segments(spark, folder):
    return heat.explode_segments(V.lines(spark, folder))


E2 = G.TM_FLATTENING * (2 - G.TM_FLATTENING)
EP2 = E2 / (1 - E2)


def _duck_projected(table: str) -> str:
    """Transverse Mercator x and y of columns lon, lat, in steps."""
    a = G.TM_AXIS
    return f"""
        SELECT *, n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {EP2!r}) * pow(a, 5) / 120) AS x,
            {a} * ({1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256!r} * phi - {3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024!r} * sin(2 * phi)
                + {15 * E2**2 / 256 + 45 * E2**3 / 1024!r} * sin(4 * phi) - {35 * E2**3 / 3072:.20f} * sin(6 * phi))
            + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24
                + (61 - 58 * t + t * t + 600 * c - 330 * {EP2!r}) * pow(a, 6) / 720) AS y
        FROM (SELECT *, radians(lat) AS phi, {a} / sqrt(1 - {E2!r} * pow(sin(radians(lat)), 2)) AS n, pow(tan(radians(lat)), 2) AS t,
                {EP2!r} * pow(cos(radians(lat)), 2) AS c, radians(lon - 114.0) * cos(radians(lat)) AS a FROM {table})"""


@query(
    "line_length",
    V.with_views("lines_v", more=f"""points AS (SELECT id, i, coords[i].lon AS lon, coords[i].lat AS lat
        FROM (SELECT *, unnest(range(1, len(coords) + 1)) AS i FROM lines_v)), metric AS ({_duck_projected('points')})""")
    + """SELECT id, round(sum(sqrt(pow(x - x0, 2) + pow(y - y0, 2))), 3) AS metres FROM (
        SELECT *, lag(x) OVER (PARTITION BY id ORDER BY i) AS x0, lag(y) OVER (PARTITION BY id ORDER BY i) AS y0 FROM metric) GROUP BY id""",
)
def line_length(spark, folder):
    return V.lines(spark, folder).select("id", F.round(G.line_length(F.col("coords")), 3).alias("metres"))


def _duck_wave(v: str, terms) -> str:
    return "(" + " + ".join(f"{w} * sin({v} * {f * math.pi!r})" for w, f in terms) + ") * 2.0 / 3.0"


def _duck_shift(lon: str, lat: str) -> tuple[str, str]:
    """WGS-84 to GCJ-02 as SQL expressions of two columns."""
    x, y = f"({lon} - 105.0)", f"({lat} - 35.0)"
    shared = _duck_wave(x, [(20, 6), (20, 2)])
    d_lat = (
        f"(-100.0 + 2 * {x} + 3 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {shared} + "
        f"{_duck_wave(y, [(20, 1), (40, 1 / 3)])} + {_duck_wave(y, [(160, 1 / 12), (320, 1 / 30)])})"
    )
    d_lon = (
        f"(300.0 + {x} + 2 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {shared} + "
        f"{_duck_wave(x, [(20, 1), (40, 1 / 3)])} + {_duck_wave(x, [(150, 1 / 12), (300, 1 / 30)])})"
    )
    root = f"sqrt(1 - {datum.ECCENTRICITY!r} * pow(sin(radians({lat})), 2))"
    north = f"{d_lat} * 180.0 / ({datum.AXIS * (1 - datum.ECCENTRICITY) * math.pi!r} / pow({root}, 3))"
    east = f"{d_lon} * 180.0 / ({datum.AXIS * math.pi!r} / {root} * cos(radians({lat})))"
    return f"({lon} + {east})", f"({lat} + {north})"


SHIFTED = _duck_shift("coords[i].lon", "coords[i].lat")


@query(
    "datum_shift",
    V.with_views("lines_v") + f"""SELECT id, (i - 1)::INTEGER AS pos, round({SHIFTED[0]}, 7) AS lon, round({SHIFTED[1]}, 7) AS lat, true AS returns
        FROM (SELECT *, unnest(range(1, len(coords) + 1)) AS i FROM lines_v)""",
)
def datum_shift(spark, folder):
    shifted = V.lines(spark, folder).withColumn("shifted", datum.shift_line(F.col("coords"), "wgs84", "gcj02"))
    back = datum.shift_line(F.col("shifted"), "gcj02", "wgs84")
    rows = shifted.select("id", F.posexplode(F.arrays_zip("coords", "shifted", back.alias("back"))).alias("pos", "z"))
    near = (F.abs(F.col("z.back.lon") - F.col("z.coords.lon")) < 1e-4) & (F.abs(F.col("z.back.lat") - F.col("z.coords.lat")) < 1e-4)
    return rows.select(
        "id", "pos", F.round("z.shifted.lon", 7).alias("lon"), F.round("z.shifted.lat", 7).alias("lat"), near.alias("returns")
    )


def _duck_request(end: str) -> str:
    lon, lat = _duck_shift(f"round(lon_{end}, 7)", f"round(lat_{end}, 6)")
    return f"{V.duck_degree(f'round({lon}, 6)')} || ',' || {V.duck_degree(f'round({lat}, 6)')}"


@query("od_coords", V.with_views("poi_v") + f"SELECT id AS OD, {_duck_request('0')} AS origin, {_duck_request('1')} AS destination FROM poi_v")
def od_coords(spark, folder):
    return routes.od_coords(V.poi(spark, folder).withColumnRenamed("id", "OD"))


def _first_batch(rows):
    """The lines that came from one source."""
    return rows.where("source = 'Brand#1'")


def _dictionary(spark, folder):
    """Dictionary of the paths; their repeated lines share an id."""
    return paths.upsert(paths.empty(spark), V.paths(spark, folder))


@query(
    "dict_upsert",
    V.with_views("paths_v") + f"""SELECT {WKT} AS wkt, count(*) FILTER (source = 'Brand#1') > 0 AS old, 1::BIGINT AS ids, true AS dense
        FROM paths_v GROUP BY {WKT}""",
)
def dict_upsert(spark, folder):
    rows = V.paths(spark, folder)
    store = paths.PathStore(spark, new_path(spark, "paths"))
    before = store.add(_first_batch(rows)).count()
    grown = store.add(rows)
    return grown.groupBy(F.col("_wkt").alias("wkt")).agg(
        (F.min("fid") < before).alias("old"), F.countDistinct("fid").alias("ids"), (F.max("fid") < grown.count()).alias("dense")
    )


@query(
    "dict_lookup",
    V.with_views("paths_v") + f"""SELECT fid, CASE WHEN {WKT} IN (SELECT {WKT} FROM paths_v WHERE source = 'Brand#1') THEN {WKT} END AS found FROM paths_v""",
)
def dict_lookup(spark, folder):
    rows = V.paths(spark, folder)
    dictionary = paths.upsert(paths.empty(spark), _first_batch(rows))
    found = paths.lookup(rows.withColumnRenamed("fid", "row"), dictionary)
    return found.select(F.col("row").alias("fid"), F.when(F.col("fid").isNotNull(), G.line_wkt(F.col("coords"))).alias("found"))


@query(
    "dict_join",
    V.with_views("paths_v") + f"SELECT fid, {WKT} AS wkt FROM paths_v WHERE {WKT} IN (SELECT {WKT} FROM paths_v WHERE source = 'Brand#1')",
)
def dict_join(spark, folder):
    rows = V.paths(spark, folder)
    dictionary = paths.upsert(paths.empty(spark), _first_batch(rows))
    found = paths.lookup(rows.withColumnRenamed("fid", "row"), dictionary, how="inner").select("row", "fid")
    return paths.with_lines(found, dictionary).select(F.col("row").alias("fid"), F.col("_wkt").alias("wkt"))


@query(
    "dict_get",
    V.with_views("paths_v") + f"SELECT DISTINCT {WKT} AS wkt FROM paths_v WHERE source = 'Brand#1'",
)
def dict_get(spark, folder):
    dictionary = _dictionary(spark, folder)
    wanted = paths.lookup(_first_batch(V.paths(spark, folder)).drop("fid"), dictionary)
    return paths.get(dictionary, wanted).select(F.col("_wkt").alias("wkt"))


@query(
    "dict_remove",
    V.with_views("paths_v") + f"SELECT DISTINCT {WKT} AS wkt FROM paths_v WHERE {WKT} NOT IN (SELECT {WKT} FROM paths_v WHERE source = 'Brand#1')",
)
def dict_remove(spark, folder):
    rows = V.paths(spark, folder)
    return paths.remove(_dictionary(spark, folder), _first_batch(rows)).select(F.col("_wkt").alias("wkt"))


@query(
    "left_paths",
    V.with_views("trips_v") + "SELECT k1, k2, k3, k4, fid, CASE WHEN p_partkey IS NOT NULL THEN 4 END AS vertices FROM trips_v LEFT JOIN part ON p_partkey = fid",
)
def left_paths(spark, folder):
    shapes = V.paths(spark, folder).select("fid", F.size("coords").alias("vertices"))
    return frames.join_unique(V.trips(spark, folder), shapes, ["fid"], "left").select("k1", "k2", "k3", "k4", "fid", "vertices")


@query(
    "right_shapes",
    V.with_views("trips_v", "paths_v") + f"""SELECT fid, nums, {WKT} AS wkt FROM (SELECT fid, count(*) AS nums FROM trips_v WHERE fid IS NOT NULL GROUP BY fid)
        LEFT JOIN (SELECT * REPLACE (CASE WHEN source = 'Brand#3' THEN -1 - fid ELSE fid END AS fid) FROM paths_v) USING (fid)""",
)
def right_shapes(spark, folder):
    nums = heat.path_use(V.trips(spark, folder), []).withColumnRenamed("used", "nums")
    shapes = V.paths(spark, folder).withColumn("fid", F.expr("case when source = 'Brand#3' then -1 - fid else fid end"))
    return shapes.join(nums, "fid", "right").select("fid", "nums", G.line_wkt(F.col("coords")).alias("wkt"))


RING_ROWS = ", ".join(
    f"({i}, '{BRIDGE_NAMES[i]}', {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
    for i, ring in BRIDGE_RINGS.items() for a, b in zip(ring, ring[1:])
)


def _duck_turn(o, a, b):
    return f"(({a}x - {o}x) * ({b}y - {o}y) - ({a}y - {o}y) * ({b}x - {o}x))"


SPATIAL = V.with_views("lines_v", more=f"""
    ring(id, bridge, ex, ey, fx, fy) AS (VALUES {RING_ROWS}),
    parts AS (SELECT id, coords[i].lon AS sx, coords[i].lat AS sy, coords[i + 1].lon AS tx, coords[i + 1].lat AS ty
        FROM (SELECT *, unnest(range(1, len(coords))) AS i FROM lines_v)),
    crossing AS (SELECT DISTINCT p.id, bridge FROM parts p, ring r
        WHERE least(sx, tx) <= greatest(ex, fx) AND least(ex, fx) <= greatest(sx, tx)
          AND least(sy, ty) <= greatest(ey, fy) AND least(ey, fy) <= greatest(sy, ty)
          AND {_duck_turn('e', 'f', 's')} * {_duck_turn('e', 'f', 't')} <= 0
          AND {_duck_turn('s', 't', 'e')} * {_duck_turn('s', 't', 'f')} <= 0),
    inside AS (SELECT p.id, bridge FROM (SELECT id, unnest(coords) AS v FROM lines_v) p, ring r
        WHERE (ey > v.lat) <> (fy > v.lat) AND v.lon < (fx - ex) * (v.lat - ey) / (fy - ey) + ex
        GROUP BY p.id, v, bridge HAVING count(*) % 2 = 1),
    hits AS (SELECT * FROM crossing UNION SELECT id, bridge FROM inside)""")


@query("spatial_left", SPATIAL + "SELECT l.id, h.bridge FROM lines_v l LEFT JOIN hits h ON l.id = h.id")
def spatial_left(spark, folder):
    return spatial.join_polygons(V.lines(spark, folder), spatial.bridge_polygons(spark), "id").select("id", "bridge")


SPATIAL_MANY = V.with_views("lines_v", more=f"""
    firsts AS (SELECT id, coords[1].lon AS x, coords[1].lat AS y, 0.0005::DOUBLE * (1 + id % 5) AS r FROM lines_v),
    spans AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM firsts HAVING count(*) > 0),
    corners AS (
        SELECT id AS area, [x - r, x, x + r, x, x - r] AS xs, [y, y - r, y, y + r, y] AS ys FROM firsts
        UNION ALL SELECT -1, [x0, (x0 + x1) / 2, x1, (x0 + x1) / 2, x0], [(y0 + y1) / 2, y0, (y0 + y1) / 2, y1, (y0 + y1) / 2] FROM spans),
    ring AS (SELECT area, xs[i] AS ex, ys[i] AS ey, xs[i + 1] AS fx, ys[i + 1] AS fy FROM (SELECT *, unnest(range(1, 5)) AS i FROM corners)),
    parts AS (SELECT id, coords[i].lon AS sx, coords[i].lat AS sy, coords[i + 1].lon AS tx, coords[i + 1].lat AS ty
        FROM (SELECT *, unnest(range(1, len(coords))) AS i FROM lines_v)),
    crossing AS (SELECT DISTINCT p.id, area FROM parts p, ring r
        WHERE least(sx, tx) <= greatest(ex, fx) AND least(ex, fx) <= greatest(sx, tx)
          AND least(sy, ty) <= greatest(ey, fy) AND least(ey, fy) <= greatest(sy, ty)
          AND {_duck_turn('e', 'f', 's')} * {_duck_turn('e', 'f', 't')} <= 0
          AND {_duck_turn('s', 't', 'e')} * {_duck_turn('s', 't', 'f')} <= 0),
    inside AS (SELECT f.id, area FROM firsts f, ring r
        WHERE (ey > f.y) <> (fy > f.y) AND f.x < (fx - ex) * (f.y - ey) / (fy - ey) + ex
        GROUP BY f.id, area HAVING count(*) % 2 = 1),
    hits AS (SELECT * FROM crossing UNION SELECT id, area FROM inside)""")


@query("spatial_many", SPATIAL_MANY + "SELECT l.id, h.area FROM lines_v l LEFT JOIN hits h ON l.id = h.id")
def spatial_many(spark, folder):
    """Lines with many areas: a small one around the first vertex of each line, and a large one over most of them."""
    lines = V.lines(spark, folder)
    firsts = lines.select("id", F.col("coords")[0]["lon"].alias("x"), F.col("coords")[0]["lat"].alias("y")).withColumn(
        "r", F.lit(0.0005) * (1 + F.col("id") % 5))
    spans = firsts.agg(*[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]).where("x0 is not null")
    x, y, r = (F.col(c) for c in ("x", "y", "r"))
    around = [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    over = [(F.col("x0"), my), (mx, F.col("y0")), (F.col("x1"), my), (mx, F.col("y1")), (F.col("x0"), my)]
    ring = lambda corners: F.array(F.array(*[G.point(*c) for c in corners])).alias("rings")
    rows = firsts.select(F.col("id").alias("area"), ring(around)).unionByName(spans.select(F.lit(-1).cast("bigint").alias("area"), ring(over)))
    return spatial.join_polygons(lines, spatial.polygons(rows), "id", label="area").select("id", "area")


def duck_near(table: str, key: str) -> str:
    """Unordered near-equal pairs of a table with ``coords``, compared directly."""
    near = (
        "list_bool_and(list_transform(range(1, len(a.coords) + 1), lambda i: sqrt(pow(a.coords[i].lon - b.coords[i].lon, 2) "
        "+ pow(a.coords[i].lat - b.coords[i].lat, 2)) <= 0.00005::DOUBLE))"
    )
    boxes = (
        "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
    )
    boxed = (
        f"(SELECT {key} AS id, coords, list_min(list_transform(coords, lambda p: p.lon)) AS x0, list_max(list_transform(coords, lambda p: p.lon)) AS x1, "
        "list_min(list_transform(coords, lambda p: p.lat)) AS y0, list_max(list_transform(coords, lambda p: p.lat)) AS y1, "
        f"floor(coords[1].lon / 0.0002)::BIGINT AS cell FROM {table})"
    )
    return f"""SELECT a.id AS a, b.id AS b FROM {boxed} a JOIN (SELECT *, unnest([cell - 1, cell, cell + 1]) AS near_cell FROM {boxed}) b
        ON a.cell = b.near_cell WHERE a.id < b.id AND {boxes} AND abs(a.coords[1].lat - b.coords[1].lat) <= 0.0001 AND {near}"""


@query(
    "almost_equal",
    V.with_views("near_v", more=f"pairs AS ({duck_near('near_v', 'id')}), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)")
    + "SELECT a AS id, b AS almost_equal FROM both_ways UNION ALL SELECT DISTINCT a, a FROM both_ways",
)
def almost_equal(spark, folder):
    return spatial.almost_equal(V.near_lines(spark, folder), "id")


def duck_groups(pairs: str) -> str:
    """Connected components of small pair tables, by walking from every node."""
    return f"""links AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
        reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


def duck_merged(table: str, cap: float | None, order: str, columns: str) -> str:
    keep = "true" if cap is None else f"round(total, 9) <= {cap}"
    return f"""SELECT {columns}, CASE WHEN component IS NOT NULL AND {keep} THEN total ELSE freq END AS merged_freq,
            CASE WHEN component IS NOT NULL AND {keep} THEN n ELSE 1 END AS members
        FROM (SELECT e.*, component, sum(freq) OVER w AS total, count(*) OVER w AS n, row_number() OVER (PARTITION BY component ORDER BY freq DESC, {order}) AS place
              FROM {table} e LEFT JOIN groups g ON e.id = g.node WINDOW w AS (PARTITION BY component))
        WHERE component IS NULL OR place = 1 OR NOT ({keep})"""


@query(
    "merge_equal_edges",
    V.with_views("near_v", recursive=True, more=f"pairs AS ({duck_near('near_v', 'id')}), {duck_groups('pairs')}")
    + f"SELECT id, round(merged_freq, 6) AS freq, members FROM ({duck_merged('near_v', 1.0, 'id', 'id')})",
)
def merge_equal_edges(spark, folder):
    merged = heat.merge_equal_edges(V.near_lines(spark, folder), cap=1.0)
    return merged.select("id", F.round("freq", 6).alias("freq"), "members")


def _duck_fold(cap: float) -> str:
    """The greedy fold of small components, edge by edge in order."""
    return f"""members AS (SELECT component, e.id, freq, (SELECT list(b) FROM links WHERE a = e.id) AS partners,
            row_number() OVER (PARTITION BY component ORDER BY freq DESC, ('0x' || md5(e.id::VARCHAR)[1:15])::BIGINT, e.id) AS place
        FROM near_freq e JOIN groups g ON e.id = g.node),
    fold AS (
        SELECT component, 0::BIGINT AS place, []::BIGINT[] AS done, NULL::BIGINT AS id, NULL::DOUBLE AS freq, 1::BIGINT AS members FROM members WHERE place = 1
        UNION ALL
        SELECT component, place, CASE WHEN skip THEN done WHEN fits THEN list_concat(done, [id], found) ELSE list_append(done, id) END,
            CASE WHEN NOT skip THEN id END, CASE WHEN fits THEN total ELSE freq END, CASE WHEN fits THEN len(found) + 1 ELSE 1 END
        FROM (SELECT *, round(total, 9) <= {cap} AS fits FROM (
            SELECT *, freq + coalesce((SELECT sum(freq) FROM near_freq WHERE id IN (SELECT unnest(found))), 0) AS total FROM (
                SELECT m.*, f.done, list_contains(f.done, m.id) AS skip, list_filter(m.partners, lambda p: NOT list_contains(f.done, p)) AS found
                FROM fold f JOIN members m ON m.component = f.component AND m.place = f.place + 1))))"""


@query(
    "fold_equal_edges",
    V.with_views("near_v", recursive=True, more=f"""near_freq AS (SELECT id, 0.2::DOUBLE + (id % 5) * 0.1::DOUBLE AS freq, coords FROM near_v),
    pairs AS ({duck_near('near_v', 'id')}), {duck_groups('pairs')}, {_duck_fold(1.0)}""")
    + """SELECT id, round(freq, 6) AS freq, members FROM fold WHERE id IS NOT NULL
        UNION ALL SELECT id, round(freq, 6), 1 FROM near_freq WHERE id NOT IN (SELECT node FROM groups)""",
)
def fold_equal_edges(spark, folder):
    edges = V.near_lines(spark, folder).withColumn("freq", F.expr("0.2D + (id % 5) * 0.1D"))
    folded = heat.fold_equal_edges(edges, cap=1.0)
    return folded.select("id", F.round("freq", 6).alias("freq"), "members")


FINE = """fine AS (SELECT row_number() OVER (ORDER BY a_lon, a_lat, b_lon, b_lat) AS id, *,
        [struct_pack(lon := a_lon, lat := a_lat), struct_pack(lon := b_lon, lat := b_lat)] AS coords
    FROM (SELECT coords[i].lon AS a_lon, coords[i].lat AS a_lat, coords[i + 1].lon AS b_lon, coords[i + 1].lat AS b_lat, sum(freq) AS freq
          FROM (SELECT *, unnest(range(1, len(coords))) AS i FROM near_v) GROUP BY ALL))"""


@query(
    "merge_fine",
    V.with_views("near_v", recursive=True, more=f"{FINE}, pairs AS ({duck_near('fine', 'id')}), {duck_groups('pairs')}")
    + f"""SELECT a_lon, a_lat, b_lon, b_lat, round(merged_freq, 6) AS freq, members
        FROM ({duck_merged('fine', None, 'a_lon, a_lat, b_lon, b_lat', 'a_lon, a_lat, b_lon, b_lat')})""",
)
def merge_fine(spark, folder):
    merged = heat.merge_fine(V.near_lines(spark, folder).select("coords", "freq"))
    return merged.select(*heat.SEGMENT, F.round("freq", 6).alias("freq"), "members")


USED_SEGMENTS = """SELECT {od} coords[i].lon AS a_lon, coords[i].lat AS a_lat, coords[i + 1].lon AS b_lon, coords[i + 1].lat AS b_lat, count(*) AS n
    FROM (SELECT od, coords, unnest(range(1, len(coords))) AS i FROM trips_v JOIN paths_v USING (fid)) GROUP BY ALL"""


@query("segment_count", V.with_views("trips_v", "paths_v") + f"SELECT * EXCLUDE (n), n AS count FROM ({USED_SEGMENTS.format(od='')})")
def segment_count(spark, folder):
    return heat.segment_count(V.trips(spark, folder), V.paths(spark, folder))


@query(
    "segment_ratio",
    V.with_views("trips_v", "paths_v") + f"""SELECT a_lon, a_lat, b_lon, b_lat, round(avg(r), 6) AS freq
        FROM (SELECT *, n / max(n) OVER (PARTITION BY od) AS r FROM ({USED_SEGMENTS.format(od='od,')})) GROUP BY ALL""",
)
def segment_ratio(spark, folder):
    ratios = heat.segment_ratio(V.trips(spark, folder).withColumnRenamed("od", "OD"), V.paths(spark, folder))
    return ratios.withColumn("freq", F.round("freq", 6))
