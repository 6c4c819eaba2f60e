"""Periods, calendar flags, weekends and polling slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor.constants import ANALYSIS_PERIODS, HOLIDAYS, HOLIDAY_WINDOW


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def period(ts: Column, bounds: list[str] = ANALYSIS_PERIODS, outside: int | None = -1) -> Column:
    """1-based period of ``ts``; each period excludes its start and includes its end."""
    picked = None
    for number, (low, high) in enumerate(zip(bounds, bounds[1:]), start=1):
        hit = (ts > _ts(low)) & (ts <= _ts(high))
        picked = F.when(hit, number) if picked is None else picked.when(hit, number)
    return picked.otherwise(F.lit(outside).cast("int"))


def holiday_period(ts: Column, current: Column, window=HOLIDAY_WINDOW, number: int = 5) -> Column:
    """Move rows inside a half-open holiday window to a period of their own."""
    return F.when((ts >= _ts(window[0])) & (ts < _ts(window[1])), number).otherwise(current)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_holiday(date: Column, holidays: list[str] = HOLIDAYS) -> Column:
    return date.isin([F.lit(d).cast("date") for d in holidays])


def holiday_or_weekend(date: Column, holidays: list[str] = HOLIDAYS) -> Column:
    return is_holiday(date, holidays) | (day_of_week(date) >= 5)


def weekends(start: Column, end: Column) -> Column:
    """Array of Saturday-to-Monday intervals in ``[start, end]``, clipped to it."""
    first_day = F.date_sub(start.cast("date"), 1)
    days = F.sequence(first_day, end.cast("date"), F.expr("interval 1 day"))
    saturdays = F.filter(days, lambda d: F.weekday(d) == 5)
    spans = F.transform(
        saturdays,
        lambda d: F.struct(
            F.greatest(d.cast("timestamp_ntz"), start).alias("begin"),
            F.least(F.date_add(d, 2).cast("timestamp_ntz"), end).alias("finish"),
        ),
    )
    return F.filter(spans, lambda s: s["begin"] < s["finish"])


def off_cadence_slots(last: float) -> list[float]:
    """Quarter-past and quarter-to slots of the half-hourly night polling."""
    return [n * 0.5 + 0.25 for n in range(int((last - 0.25) / 0.5) + 1)]


def on_cadence(t: Column, last: float = 5.75) -> Column:
    """True for slots the poller visits every day."""
    return ~t.isin(off_cadence_slots(last))
