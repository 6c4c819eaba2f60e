"""Positional ids: a trip id is ``ddHHMM`` followed by a three-digit OD.

A step id is ``ddHHMM``, the OD without padding, then the step. Leading zeros of
the day are lost in both, so ids are read from the right or with a known width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FILE_DATE = r"_(\d{6})\.\w+$"


def parse_date(value: Column, fmt: str = "yyyyMMdd") -> Column:
    """An int or text date to a date."""
    return F.to_date(value.cast("string"), fmt)


def date_from_file_name(path: Column) -> Column:
    """The date in a file name that ends with ``_yyMMdd.ext``; null without one."""
    digits = F.regexp_extract(path, _FILE_DATE, 1)
    return F.when(digits != "", F.to_date(F.concat(F.lit("20"), digits), "yyyyMMdd"))


def od_of(trip_id: Column) -> Column:
    """Last three digits of a numeric trip id."""
    return F.pmod(trip_id.cast("bigint"), F.lit(1000).cast("bigint")).cast("int")


def clock_digits(trip_id: Column) -> Column:
    """The ``HHMM`` part of a trip id, counted from the right."""
    return F.substring(trip_id.cast("string"), -7, 4)


def day_width(step_or_trip_id: Column, date: Column) -> Column:
    """How many digits the day takes: two if the id starts with the full day."""
    same = F.substring(step_or_trip_id, 1, 2) == F.date_format(date, "dd")
    return F.when(same, F.lit(2)).otherwise(F.lit(1))


def clock_after_day(some_id: Column, width: Column) -> Column:
    """The ``HHMM`` digits that follow the day."""
    return some_id.substr(width + F.lit(1), F.lit(4))


def at_clock(date: Column, digits: Column) -> Column:
    """Timestamp of ``HHMM`` digits on a date; null for impossible digits."""
    text = F.concat(date.cast("string"), F.lit(" "), digits)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz")


def hour_fraction(digits: Column) -> Column:
    """``HHMM`` digits as hours, so 0630 is 6.5."""
    value = digits.try_cast("int")
    return F.floor(value / F.lit(100)).cast("double") + (value % F.lit(100)).cast("double") / F.lit(60.0)


def hour_of(ts: Column) -> Column:
    """Time of day of a timestamp in hours."""
    return F.hour(ts).cast("double") + F.minute(ts).cast("double") / F.lit(60.0)


def from_hour_fraction(date: Column, hours: Column) -> Column:
    """Timestamp of a fractional hour on a date, minutes truncated."""
    whole = F.floor(hours).cast("int")
    minute = F.floor((hours - whole) * F.lit(60)).cast("int")
    text = F.format_string("%02d%02d", whole, minute)
    return at_clock(date, text)


def step_after_prefix(step_id: Column, trip_id: Column) -> Column:
    """Step number of an id ``ddHHMM`` + ``(trip * 100 + step)``."""
    tail = F.substr(step_id, F.lit(7)).try_cast("bigint")
    return (tail - trip_id.cast("bigint") * F.lit(100)).cast("int")


def step_after_underscore(step_id: Column) -> Column:
    """Step number after the last underscore."""
    return F.substring_index(step_id, "_", -1).try_cast("int")
