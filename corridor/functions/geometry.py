"""Geometry as Column expressions on ``array<struct<lon,lat>>``."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor.constants import EARTH_RADIUS_KM

# Ellipsoid and central meridian of the metric projection.
TM_AXIS = 6378245.0
TM_FLATTENING = 1 / 298.3
TM_MERIDIAN = 114.0


def computed_once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def round_degrees(value: Column, digits: int = 6) -> Column:
    """Half-even rounding, as the coordinate keys need."""
    return F.bround(value, digits)


def parse_polyline(text: Column) -> Column:
    """``lon,lat;lon,lat`` text to points; parts that are no points are dropped (``bad_points`` counts them)."""
    points = F.transform(
        F.split(text, ";"),
        lambda n: F.struct(
            F.get(F.split(n, ","), F.lit(0)).try_cast("double").alias("lon"),
            F.get(F.split(n, ","), F.lit(1)).try_cast("double").alias("lat"),
        ),
    )
    return F.filter(points, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())


def bad_points(text: Column) -> Column:
    """How many parts of ``lon,lat;lon,lat`` text ``parse_polyline`` drops: a line with any has lost its shape and key."""
    return F.size(F.split(text, ";")) - F.size(parse_polyline(text))


def parse_wkt(text: Column) -> Column:
    """``LINESTRING (x y, x y)`` text to points."""
    body = F.regexp_extract(text, r"\((.*)\)", 1)
    return parse_polyline(F.replace(F.regexp_replace(body, r",\s*", ";"), F.lit(" "), F.lit(",")))


def round_coords(coords: Column, digits: int = 6) -> Column:
    return F.transform(
        coords,
        lambda p: point(round_degrees(p["lon"], digits), round_degrees(p["lat"], digits)),
    )


def degree_text(value: Column) -> Column:
    """A degree value with six decimals and no trailing zeros."""
    fixed = round_degrees(value).cast("decimal(12,6)").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def _pair_text(p: Column) -> Column:
    return F.concat_ws(" ", degree_text(p["lon"]), degree_text(p["lat"]))


def point_wkt(p: Column) -> Column:
    return F.when(p.isNotNull(), F.concat(F.lit("POINT ("), _pair_text(p), F.lit(")")))


def line_wkt(coords: Column) -> Column:
    """WKT with six decimals and no trailing zeros."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(coords, _pair_text), ", "), F.lit(")"))


def line_key(coords: Column) -> list[Column]:
    """A 128-bit key of a rounded line, as two columns ``key_hi`` and ``key_lo``.

    Joins and groupings shuffle these two longs and not the vertices.
    """
    return [
        F.xxhash64(coords).alias("key_hi"),
        F.xxhash64(F.lit("line"), coords).alias("key_lo"),
    ]


def start_point(coords: Column) -> Column:
    return F.get(coords, F.lit(0))


def end_point(coords: Column) -> Column:
    return F.get(coords, F.size(coords) - F.lit(1))


def segments(coords: Column) -> Column:
    """Consecutive vertex pairs ``struct<a,b>``; empty below two vertices."""
    n = F.greatest(F.size(coords) - F.lit(1), F.lit(0))
    return F.zip_with(
        F.slice(coords, F.lit(1), n),
        F.slice(coords, F.lit(2), n),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def segment_line(segment: Column) -> Column:
    return F.array(segment["a"], segment["b"])


def haversine(lon0: Column, lat0: Column, lon1: Column, lat1: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    half_lat = F.sin(F.radians(lat1 - lat0) / 2.0)
    half_lon = F.sin(F.radians(lon1 - lon0) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def project_line(coords: Column) -> Column:
    """Vertices in metres by the Transverse Mercator series (Snyder 1987, eq. 8-9, 8-10, 3-21).

    The series is taken in stages, each a transform of its own, so that every
    shared term is computed once per vertex.
    """
    e2 = TM_FLATTENING * (2 - TM_FLATTENING)
    ep2 = e2 / (1 - e2)
    angles = F.transform(
        coords,
        lambda p: F.struct(F.radians(p["lat"]).alias("phi"), F.radians(p["lon"] - F.lit(TM_MERIDIAN)).alias("east")),
    )
    trig = F.transform(
        angles,
        lambda v: F.struct(
            v["phi"].alias("phi"), v["east"].alias("east"),
            F.sin(v["phi"]).alias("sin"), F.cos(v["phi"]).alias("cos"), F.tan(v["phi"]).alias("tan"),
        ),
    )
    terms = F.transform(
        trig,
        lambda v: F.struct(
            v["phi"].alias("phi"), v["tan"].alias("tan"),
            (F.lit(TM_AXIS) / F.sqrt(F.lit(1.0) - F.lit(e2) * v["sin"] * v["sin"])).alias("n"),
            (v["tan"] * v["tan"]).alias("t"), (F.lit(ep2) * v["cos"] * v["cos"]).alias("c"),
            (v["east"] * v["cos"]).alias("a"),
        ),
    )
    arc_terms = (
        1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256,
        3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024,
        15 * e2**2 / 256 + 45 * e2**3 / 1024,
        35 * e2**3 / 3072,
    )

    def metres(v: Column) -> Column:
        phi, n, t, c, a = (v[k] for k in ("phi", "n", "t", "c", "a"))
        x = a + (F.lit(1.0) - t + c) * F.pow(a, F.lit(3.0)) / 6.0 + (
            F.lit(5.0 - 58.0 * ep2) - t * 18.0 + t * t + c * 72.0
        ) * F.pow(a, F.lit(5.0)) / 120.0
        arc = (
            phi * F.lit(arc_terms[0]) - F.sin(phi * 2.0) * F.lit(arc_terms[1])
            + F.sin(phi * 4.0) * F.lit(arc_terms[2]) - F.sin(phi * 6.0) * F.lit(arc_terms[3])
        )
        y = a * a / 2.0 + (F.lit(5.0) - t + c * 9.0 + c * c * 4.0) * F.pow(a, F.lit(4.0)) / 24.0 + (
            F.lit(61.0 - 330.0 * ep2) - t * 58.0 + t * t + c * 600.0
        ) * F.pow(a, F.lit(6.0)) / 720.0
        return F.struct((n * x).alias("x"), (F.lit(TM_AXIS) * arc + n * v["tan"] * y).alias("y"))

    return F.transform(terms, metres)


def line_length(coords: Column) -> Column:
    """Length in metres of a line of degrees."""
    def total(line: Column) -> Column:
        steps = F.transform(
            segments(line), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
        )
        return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)

    return computed_once(project_line(coords), total)


def bounds(coords: Column) -> Column:
    """Bounding box ``struct<x0,y0,x1,y1>``."""
    lon = F.transform(coords, lambda p: p["lon"])
    lat = F.transform(coords, lambda p: p["lat"])
    return F.struct(
        F.array_min(lon).alias("x0"), F.array_min(lat).alias("y0"),
        F.array_max(lon).alias("x1"), F.array_max(lat).alias("y1"),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (a["lat"] - o["lat"]) * (b["lon"] - o["lon"])


def segment_box(s: Column) -> Column:
    return F.struct(
        F.least(s["a"]["lon"], s["b"]["lon"]).alias("x0"), F.least(s["a"]["lat"], s["b"]["lat"]).alias("y0"),
        F.greatest(s["a"]["lon"], s["b"]["lon"]).alias("x1"), F.greatest(s["a"]["lat"], s["b"]["lat"]).alias("y1"),
    )


def segments_touch(s: Column, e: Column) -> Column:
    """Closed segments share a point; zero-length ones count as points."""
    return (
        boxes_meet(segment_box(s), segment_box(e))
        & (_turn(e["a"], e["b"], s["a"]) * _turn(e["a"], e["b"], s["b"]) <= 0)
        & (_turn(s["a"], s["b"], e["a"]) * _turn(s["a"], s["b"], e["b"]) <= 0)
    )


def point_inside(p: Column, edges: Column) -> Column:
    """Even-odd ray casting over all ring edges of a polygon."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = F.try_divide((b["lon"] - a["lon"]) * (p["lat"] - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return ((a["lat"] > p["lat"]) != (b["lat"] > p["lat"])) & (p["lon"] < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def line_meets_polygon(coords: Column, edges: Column) -> Column:
    """A line meets a polygon if it touches an edge or starts inside."""
    crossing = F.exists(segments(coords), lambda s: F.exists(edges, lambda e: segments_touch(s, e)))
    return crossing | point_inside(start_point(coords), edges)


def almost_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Same vertex count and every vertex pair within ``tolerance``."""
    near = F.zip_with(
        a, b,
        lambda p, q: F.sqrt(
            (p["lon"] - q["lon"]) * (p["lon"] - q["lon"]) + (p["lat"] - q["lat"]) * (p["lat"] - q["lat"])
        ) <= F.lit(tolerance),
    )
    return (F.size(a) == F.size(b)) & F.forall(near, lambda v: v)
