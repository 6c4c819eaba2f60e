"""Closed-form shifts between the WGS-84, GCJ-02 and BD-09 datums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid of the published GCJ-02 formula, and the BD-09 angle.
AXIS = 6378245.0
ECCENTRICITY = 0.00669342162296594323
BD_ANGLE = math.pi * 3000.0 / 180.0


def _waves(value: Column, terms) -> Column:
    total = F.lit(0.0)
    for weight, frequency in terms:
        total = total + F.sin(value * F.lit(frequency * math.pi)) * F.lit(weight)
    return total * F.lit(2.0 / 3.0)


def _offsets(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - F.lit(105.0), lat - F.lit(35.0)
    shared = _waves(x, [(20.0, 6.0), (20.0, 2.0)])
    d_lat = (
        F.lit(-100.0) + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.2
        + shared + _waves(y, [(20.0, 1.0), (40.0, 1.0 / 3.0)])
        + _waves(y, [(160.0, 1.0 / 12.0), (320.0, 1.0 / 30.0)])
    )
    d_lon = (
        F.lit(300.0) + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.1
        + shared + _waves(x, [(20.0, 1.0), (40.0, 1.0 / 3.0)])
        + _waves(x, [(150.0, 1.0 / 12.0), (300.0, 1.0 / 30.0)])
    )
    phi = F.radians(lat)
    magic = F.lit(1.0) - F.lit(ECCENTRICITY) * F.sin(phi) * F.sin(phi)
    root = F.sqrt(magic)
    north = d_lat * 180.0 / (F.lit(AXIS * (1 - ECCENTRICITY) * math.pi) / (magic * root))
    east = d_lon * 180.0 / (F.lit(AXIS * math.pi) / root * F.cos(phi))
    return east, north


def _covered(lon: Column, lat: Column) -> Column:
    """GCJ-02 differs from WGS-84 only inside this box."""
    return (lon > 73.66) & (lon < 135.05) & (lat > 3.86) & (lat < 53.55)


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def wgs84_to_gcj02(p: Column) -> Column:
    lon, lat = p["lon"], p["lat"]
    east, north = _offsets(lon, lat)
    inside = _covered(lon, lat)
    return _point(
        F.when(inside, lon + east).otherwise(lon), F.when(inside, lat + north).otherwise(lat)
    )


def gcj02_to_wgs84(p: Column) -> Column:
    """One-step inverse: subtract the offset found at the shifted point."""
    lon, lat = p["lon"], p["lat"]
    east, north = _offsets(lon, lat)
    inside = _covered(lon, lat)
    return _point(
        F.when(inside, lon - east).otherwise(lon), F.when(inside, lat - north).otherwise(lat)
    )


def gcj02_to_bd09(p: Column) -> Column:
    lon, lat = p["lon"], p["lat"]
    z = F.sqrt(lon * lon + lat * lat) + F.sin(lat * F.lit(BD_ANGLE)) * 0.00002
    theta = F.atan2(lat, lon) + F.cos(lon * F.lit(BD_ANGLE)) * 0.000003
    return _point(z * F.cos(theta) + 0.0065, z * F.sin(theta) + 0.006)


def bd09_to_gcj02(p: Column) -> Column:
    x, y = p["lon"] - 0.0065, p["lat"] - 0.006
    z = F.sqrt(x * x + y * y) - F.sin(y * F.lit(BD_ANGLE)) * 0.00002
    theta = F.atan2(y, x) - F.cos(x * F.lit(BD_ANGLE)) * 0.000003
    return _point(z * F.cos(theta), z * F.sin(theta))


SHIFTS = {
    ("wgs84", "gcj02"): wgs84_to_gcj02,
    ("gcj02", "wgs84"): gcj02_to_wgs84,
    ("gcj02", "bd09"): gcj02_to_bd09,
    ("bd09", "gcj02"): bd09_to_gcj02,
}


def shift_point(p: Column, source: str, target: str) -> Column:
    """Shift a point; equal datums leave it as it is."""
    return p if source == target else SHIFTS[(source, target)](p)


def shift_line(coords: Column, source: str, target: str) -> Column:
    if source == target:
        return coords
    return F.transform(coords, lambda p: shift_point(p, source, target))
