"""Numeric expressions that are safe under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as double, null when the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def speed_kmh(distance_m: Column, duration_s: Column) -> Column:
    """Metres and seconds to km/h."""
    return ratio(distance_m, duration_s) * F.lit(3.6)


def to_int(value: Column) -> Column:
    """Integer part of a number or numeric text, null when it is not a number."""
    return value.try_cast("double").try_cast("int")
