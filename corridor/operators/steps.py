"""Operators on the step table and on the bridge series made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.constants import BRIDGE_NAMES
from corridor.functions import calendar, ids, text
from corridor.functions.numbers import ratio, speed_kmh
from corridor.operators.frames import with_group_stats


def parse_step_ids(df: DataFrame, fmt: str = "yyyyMMdd") -> DataFrame:
    """Split ``ID`` (day, HHMM, OD, step) into trip id, OD, date, time and step.

    The frame's ``tripID`` column holds the OD; the day's width is that of the day
    of ``date`` without padding, the OD's width its own length.
    """
    renamed = df.withColumnRenamed("tripID", "OD").withColumnRenamed("ID", "tripID")
    trip = F.col("tripID").cast("string")
    day = F.length((F.col("date").cast("int") % 100).cast("string"))
    od = F.length(F.col("OD").cast("string"))
    digits = ids.clock_after_day(trip, day)
    date = ids.parse_date(F.col("date"), fmt)
    step = trip.substr(day + od + F.lit(5), F.length(trip)).try_cast("int")
    return renamed.withColumns(
        {
            "tripID": trip, "date": date, "timestamp": ids.at_clock(date, digits),
            "t": ids.hour_fraction(digits), "stepID": step,
        }
    )


def parse_trip_ids(df: DataFrame, before: str | None = "2020-01-01") -> DataFrame:
    """Time, OD, trimmed instruction and km/h of early-era step rows."""
    early = df if before is None else df.where(F.col("date") < F.lit(before).cast("date"))
    stamp = ids.at_clock(F.col("date"), ids.clock_digits(F.col("tripID")))
    return early.withColumns(
        {
            "timestamp": stamp,
            "OD": F.substring(F.col("tripID").cast("string"), -3, 3).try_cast("int"),
            "t": ids.hour_of(stamp),
            "instruction": F.trim("instruction"),
            "speed": speed_kmh(F.col("distance"), F.col("duration")),
        }
    )


def add_step_period(df: DataFrame, bounds=None) -> DataFrame:
    """Period of a step row, -1 outside."""
    kwargs = {} if bounds is None else {"bounds": bounds}
    return df.withColumn("period", calendar.period(F.col("timestamp"), **kwargs))


def on_bridges(df: DataFrame) -> DataFrame:
    """Step rows whose instruction names a bridge, with the bridge's number."""
    return df.withColumn("bridge", text.first_match(F.col("instruction"))).where("bridge > 0")


def bridge_speed(df: DataFrame) -> DataFrame:
    """Mean speed per period, timestamp and bridge."""
    return df.groupBy("period", "timestamp", "bridge").agg(F.avg("speed").alias("avg_speed"))


def bridge_congestion(series: DataFrame) -> DataFrame:
    """Named bridges with highest mean speed over mean speed."""
    named = series.withColumn("bridge", text.label(F.col("bridge"), BRIDGE_NAMES))
    return with_group_stats(named, ["bridge"], max_speed=F.max("avg_speed")).withColumn(
        "ci", ratio(F.col("max_speed"), F.col("avg_speed"))
    )


def drop_off_cadence(df: DataFrame, last: float = 6.75) -> DataFrame:
    """Add ``t`` and drop the night slots that are polled on some days only."""
    return df.withColumn("t", ids.hour_of(F.col("timestamp"))).where(calendar.on_cadence(F.col("t"), last))


def step_number_from_rows(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Step number as row index minus the first row index of the trip (gaps count)."""
    return with_group_stats(df, keys, _first=F.min(row)).withColumn(
        "step_id", (F.col(row) - F.col("_first")).cast("int")
    ).drop("_first")


def step_frequency(df: DataFrame) -> DataFrame:
    """How often each geometry occurs per poll of its OD and period."""
    nums = df.groupBy("OD", "period", "fid").agg(F.count("tripID").alias("nums"))
    polls = df.groupBy("OD", "period").agg(F.countDistinct("timestamp").alias("total_nums"))
    return nums.join(polls, ["OD", "period"]).select(
        "OD", "period", "fid", "nums", ratio(F.col("nums"), F.col("total_nums")).alias("freq")
    )


def day_coverage(df: DataFrame, more_than: int = 48, drop: tuple[str, ...] = ("tripID",)) -> DataFrame:
    """Steps, whatever their trip, seen on more than ``more_than`` different days."""
    rest = [c for c in df.columns if c not in drop and c != "date"]
    found = df.select(*rest, "date").distinct().groupBy(*rest).agg(
        F.array_sort(F.collect_set("date")).alias("date_lst"), F.count("date").alias("date_count")
    )
    return found.where(F.col("date_count") > more_than)


def ci_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean congestion index per key with a normal 95 % band."""
    half = F.coalesce(F.stddev_samp("ci") / F.sqrt(F.count("ci")) * 1.96, F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.avg("ci").alias("ci_mean"),
        (F.avg("ci") - half).alias("ci_low"),
        (F.avg("ci") + half).alias("ci_high"),
        F.count("ci").alias("n"),
    )


def weekend_intervals(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Weekends between the first and the last timestamp of ``df``."""
    span = df.agg(F.min(ts).alias("x0"), F.max(ts).alias("x1"))
    return span.select(F.explode(calendar.weekends(F.col("x0"), F.col("x1"))).alias("w")).select("w.begin", "w.finish")
