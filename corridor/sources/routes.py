"""Route-planning answers (nested JSON) flattened to trip, step, segment and point rows.

A raw row is ``od int, crawl string (ddHHMM), body string``. Only the first path
of an answer is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor import schemas
from corridor.functions import geometry as G
from corridor.functions.datum import shift_line, shift_point
from corridor.functions.numbers import ratio, to_int
from corridor.functions.text import status_code

STATUS_COLUMNS = {"smooth": 1, "slow": 2, "congested": 3, "verycongested": 4, "unknown": 0}


def parse_routes(raw: DataFrame) -> DataFrame:
    """Decode ``body`` once per row; answers without a path drop out, ``unanswered`` returns them."""
    first = F.slice(F.from_json("body", schemas.ROUTE)["route"]["paths"], 1, 1)
    return raw.withColumn("path", F.explode(first)).drop("body")


def unanswered(raw: DataFrame) -> DataFrame:
    """The raw rows that ``parse_routes`` leaves out, with a ``reason``.

    ``empty``: no text or only blanks; ``not json``: text that cannot be decoded;
    ``no route``: an answer without a list of paths, as planners send for errors;
    ``no path``: the list is empty.
    """
    text = F.col("body")
    listed = F.from_json(text, schemas.ROUTE)["route"]["paths"]
    reason = (
        F.when(F.size(listed) == 0, "no path")
        .when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.try_parse_json(text).isNull(), "not json")
        .otherwise("no route")
    )
    return raw.where(listed.isNull() | (F.size(listed) == 0)).withColumn("reason", reason)


def trip_id() -> Column:
    """``int(ddHHMM) * 1000 + od``."""
    return F.col("crawl").cast("bigint") * 1000 + F.col("od")


def _shifted(polyline: Column, source: str, target: str) -> Column:
    return shift_line(G.parse_polyline(polyline), source, target)


def trip_rows(routes: DataFrame, digits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per answer: speed in m/s and the distance share of each traffic state.

    ``keep`` names further columns of the answer to carry along.
    """
    path = F.col("path")
    distance = path["distance"].try_cast("double")
    parts = F.flatten(F.transform(path["steps"], lambda s: F.coalesce(s["tmcs"], F.array())))
    coded = F.transform(
        parts, lambda t: F.struct(status_code(t["status"]).alias("code"), t["distance"].try_cast("double").alias("m"))
    )

    def share(code: int) -> Column:
        total = F.aggregate(
            F.filter("_parts", lambda t: t["code"] == code), F.lit(0.0), lambda acc, t: acc + F.coalesce(t["m"], F.lit(0.0))
        )
        return F.round(F.try_divide(total, F.col("travelDis")), digits)

    base = routes.select(
        *keep, trip_id().alias("tripID"), F.col("od").alias("OD"),
        to_int(path["duration"]).alias("duration"), distance.alias("travelDis"),
        ratio(distance, path["duration"].try_cast("double")).alias("speed"), coded.alias("_parts"),
        *[to_int(path[c]).alias(c) for c in ("toll_distance", "tolls", "traffic_lights")],
        path["strategy"].alias("strategy"),
    )
    return base.withColumns({name: share(code) for name, code in STATUS_COLUMNS.items()}).drop("_parts")


def step_rows(
    routes: DataFrame, source: str = "gcj02", target: str = "gcj02", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per step with both ids: ``od_i`` and ``ddHHMM`` + (od * 100 + i)."""
    steps = routes.select("od", "crawl", *keep, F.posexplode("path.steps").alias("i", "s"))
    numbers = [to_int(F.col(f"s.{c}")).alias(c) for c in ("distance", "tolls", "toll_distance", "duration")]
    texts = [F.col(f"s.{c}").alias(c) for c in ("instruction", "orientation", "toll_road", "action", "assistant_action")]
    return steps.select(
        *keep, F.concat_ws("_", "od", "i").alias("tripID"),
        F.concat(F.col("crawl"), (F.col("od") * 100 + F.col("i")).cast("string")).alias("ID"),
        F.col("od").alias("OD"), F.col("i").alias("step_id"), *texts,
        F.coalesce(F.col("s.road"), F.lit(" ")).alias("road"), *numbers,
        _shifted(F.col("s.polyline"), source, target).alias("coords"),
    )


def segment_rows(routes: DataFrame, source: str = "gcj02", target: str = "gcj02") -> DataFrame:
    """One row per traffic segment; id ``ddHHMM`` + (od * 10000 + i * 100 + j)."""
    steps = routes.select("od", "crawl", F.posexplode("path.steps").alias("i", "s"))
    parts = steps.select("od", "crawl", "i", F.posexplode("s.tmcs").alias("j", "t"))
    number = F.col("od") * 10000 + F.col("i") * 100 + F.col("j")
    return parts.select(
        F.concat(F.col("crawl"), number.cast("string")).alias("lineID"), F.col("od").alias("tripID"),
        F.col("i"), F.col("j"), F.col("t.lcode").alias("lcode"), to_int(F.col("t.distance")).alias("distance"),
        status_code(F.col("t.status")).alias("status"),
        _shifted(F.col("t.polyline"), source, target).alias("coords"),
    )


def kept_points(points: Column, both: bool = True, run: int = 256) -> Column:
    """Drop points that do not move away from the last kept one (0, 0 at the start).

    By default a point must differ in both coordinates; ``both=False`` keeps it if
    either differs. The fold gathers points in runs of ``run``, so that it does not
    copy all points kept so far for each new one.
    """
    def moved(last: Column, p: Column) -> Column:
        dx, dy = p["lon"] != last["lon"], p["lat"] != last["lat"]
        return dx & dy if both else dx | dy

    def add(state: Column, p: Column) -> Column:
        grown = F.concat(state["open"], F.array(p))
        full = F.size(state["open"]) >= run - 1
        kept = F.struct(
            F.when(full, F.concat(state["runs"], F.array(grown))).otherwise(state["runs"]).alias("runs"),
            F.when(full, F.array().cast(schemas.COORDS)).otherwise(grown).alias("open"), p.alias("last"),
        )
        return F.when(moved(state["last"], p), kept).otherwise(state)

    point = schemas.COORDS.removeprefix("array<").removesuffix(">")
    start = F.struct(F.array().alias("runs"), F.array().alias("open"), F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")).alias("last"))
    start = start.cast(f"struct<runs:array<{schemas.COORDS}>,open:{schemas.COORDS},last:{point}>")
    return F.aggregate(points, start, add, lambda s: F.flatten(F.concat(s["runs"], F.array(s["open"]))))


def trip_line(routes: DataFrame, source: str = "gcj02", target: str = "gcj02", both: bool = True) -> DataFrame:
    """Trip ids with the cleaned line of the whole trip."""
    points = F.flatten(F.transform("path.steps", lambda s: G.parse_polyline(s["polyline"])))
    return routes.select(
        trip_id().alias("tripID"), kept_points(shift_line(points, source, target), both).alias("coords")
    )


def point_rows(routes: DataFrame, source: str = "gcj02", target: str = "gcj02", both: bool = True) -> DataFrame:
    """One row per kept point with its position."""
    lines = trip_line(routes, source, target, both)
    return lines.select("tripID", F.posexplode("coords").alias("nodeID", "p")).select(
        "tripID", "nodeID", "p.lon", "p.lat"
    )


def od_coords(poi: DataFrame, source: str = "wgs84") -> DataFrame:
    """Request texts ``lon,lat`` of both ends of an OD in the planner's datum."""
    def text(end: str) -> Column:
        at = G.point(F.round(f"lon_{end}", 7), F.round(f"lat_{end}", 6))
        p = at if source == "gcj02" else shift_point(at, source, "gcj02")
        return F.concat_ws(",", G.degree_text(F.round(p["lon"], 6)), G.degree_text(F.round(p["lat"], 6)))

    return poi.select("OD", text("0").alias("origin"), text("1").alias("destination"))
