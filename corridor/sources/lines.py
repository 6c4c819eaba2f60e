"""Line features and GeoJSON polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor import schemas
from corridor.functions import geometry as G
from corridor.operators.spatial import polygons


def ingest_lines(features: DataFrame, text: str, wkt: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """Line text to rounded ``coords``; listed attributes dropped."""
    parsed = G.parse_wkt(F.col(text)) if wkt else G.parse_polyline(F.col(text))
    return features.withColumn("coords", G.round_coords(parsed)).drop(text, *drop)


def split_lines(features: DataFrame, text: str, drop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(line features as ``ingest_lines`` gives them, features set aside with ``bad_points``).

    A feature is set aside whole if any part of its text is no point, or if it has no
    text (``bad_points`` null): a line without the part would pass as another line.
    """
    counted = features.withColumn("bad_points", G.bad_points(F.col(text)))
    good = counted.where("bad_points = 0").drop("bad_points")
    return ingest_lines(good, text, drop=drop), counted.where("bad_points is null or bad_points > 0")


def add_geometry(lines: DataFrame, coords: str = "coords") -> DataFrame:
    """Round a coordinate column and add its text form."""
    return lines.withColumn(coords, G.round_coords(F.col(coords))).withColumn("_wkt", G.line_wkt(F.col(coords)))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON MultiPolygons as polygon rows ``id, bridge, edges, box``."""
    raw = spark.read.schema(schemas.FEATURES).option("multiLine", True).json(path)
    feature = raw.select(F.explode("features").alias("f"))
    rings = F.transform(
        F.flatten("f.geometry.coordinates"),
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))),
    )
    return polygons(feature.select("f.properties.id", "f.properties.bridge", rings.alias("rings")))
