"""Operators on the trip table: one row per OD and poll time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.constants import CITY_ORDER, EARTH_RADIUS_KM, INGEST_PERIODS
from corridor.functions import calendar, ids, text
from corridor.functions.geometry import haversine
from corridor.functions.numbers import ratio, to_int
from corridor.operators.frames import exact_quantiles, join_small, join_unique, with_group_stats
from corridor.scratch import checkpoint


def poi_distances(poi: DataFrame, radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """POI table with ``id`` renamed to ``OD`` and the great-circle distance in km."""
    distance = haversine(F.col("lon_0"), F.col("lat_0"), F.col("lon_1"), F.col("lat_1"), radius)
    return poi.withColumnsRenamed({"id": "OD"}).withColumn("great_circle_dis", distance)


def add_od(trips: DataFrame, poi: DataFrame) -> DataFrame:
    """Add origin, destination and their report ranks; trips of unknown ODs drop out."""
    keyed = trips.withColumns(
        {"OD": ids.od_of(F.col("tripID")), "speed": F.col("speed").cast("float")}
    )
    return join_small(keyed, poi.select("OD", "o", "d"), ["OD"]).withColumns(
        {
            "o_rank": text.city_rank(F.col("o"), CITY_ORDER),
            "d_rank": text.city_rank(F.col("d"), CITY_ORDER),
        }
    )


def by_od(df: DataFrame, o: str | int, d: str | int, order: list[str] = CITY_ORDER) -> DataFrame:
    """Rows of one origin and destination, each a name or a position in ``order``."""
    origin = order[o] if isinstance(o, int) else o
    destination = order[d] if isinstance(d, int) else d
    return df.where((F.col("o") == origin) & (F.col("d") == destination))


def by_predicate(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that satisfy a SQL predicate."""
    return df.where(predicate)


def add_period(df: DataFrame, ts: str = "time", bounds=None, outside: int | None = None) -> DataFrame:
    """Add ``period``; null (or ``outside``) beyond the bounds."""
    kwargs = {} if bounds is None else {"bounds": bounds}
    return df.withColumn("period", calendar.period(F.col(ts), outside=outside, **kwargs))


def add_calendar(df: DataFrame, ts: str = "time", holidays=None) -> DataFrame:
    """Add day of week (Monday 0), holiday flag and the combined free-day flag."""
    date = F.col(ts).cast("date")
    days = {} if holidays is None else {"holidays": holidays}
    return df.withColumns(
        {
            "dayofweek": calendar.day_of_week(F.col(ts)),
            "holiday": calendar.is_holiday(date, **days),
            "holiday_or_weekend": calendar.holiday_or_weekend(date, **days),
        }
    )


def congestion_index(df: DataFrame, keys: list[str] = ["OD"], speed: str = "speed") -> DataFrame:
    """Highest speed of the group over the row's speed."""
    stats = with_group_stats(df, keys, speed_max=F.max(speed))
    return stats.withColumn("ci", ratio(F.col("speed_max"), F.col(speed)))


def circuity(trips: DataFrame, poi: DataFrame) -> DataFrame:
    """Travelled distance over great-circle distance of the same origin and destination."""
    direct = poi_distances(poi).select("o", "d", "great_circle_dis")
    return join_small(trips, direct, ["o", "d"]).withColumn(
        "circuity_factor", ratio(F.col("travelDis") / 1000.0, F.col("great_circle_dis"))
    )


def bridge_share(trips: DataFrame) -> DataFrame:
    """Share of each bridge among the bridge trips of (o, d, period)."""
    keys = ["o", "d", "period"]
    known = trips.dropna(subset=[*keys, "bridge"])
    counts = known.groupBy(*keys, "bridge").agg(F.count("OD").alias("trips"))
    total = F.sum("trips").over(Window.partitionBy(*keys))  # one row per bridge by now
    return counts.withColumn("percentage", ratio(F.col("trips"), total))


def bridge_share_pivot(trips: DataFrame, bridges: list[str], periods: list[int]) -> DataFrame:
    """Bridge shares with one column per bridge and period, one row per (o, d)."""
    shares = bridge_share(trips).withColumn("_cell", F.concat_ws("_", "bridge", "period"))
    cells = [f"{b}_{p}" for b in bridges for p in periods]
    return shares.groupBy("o", "d").pivot("_cell", cells).agg(F.avg("percentage"))


def _mark_outliers(df: DataFrame, keys: list[str], column: str, factor: float) -> DataFrame:
    """Add ``_kept``; bounds are rounded to 9 decimals so that they are reproducible.

    A group of one row has no deviation, so its row is an outlier; rows with a
    null key belong to no group and are outliers too.
    """
    spread = F.stddev_samp(column) * F.lit(factor)
    bounded = with_group_stats(
        df, keys, "left", _lower=F.round(F.avg(column) - spread, 9), _upper=F.round(F.avg(column) + spread, 9)
    )
    inside = F.col(column).between(F.col("_lower"), F.col("_upper"))
    return bounded.withColumn("_kept", F.coalesce(inside, F.lit(False)))


def split_outliers(
    df: DataFrame, keys: list[str] = ["OD", "date"], column: str = "speed", factor: float = 3.0
) -> tuple[DataFrame, DataFrame]:
    """(kept, outliers) by mean plus or minus ``factor`` sample standard deviations."""
    marked = _mark_outliers(df, keys, column, factor)
    return marked.where("_kept").select(*df.columns), marked.where("not _kept").select(*df.columns)


def outlier_share(df: DataFrame, keys: list[str], column: str, factor: float = 3.0) -> DataFrame:
    """One row: number of rows, of outliers, and their percentage."""
    total, outliers = F.count(F.lit(1)), F.count_if(~F.col("_kept"))
    return _mark_outliers(df, keys, column, factor).agg(
        total.alias("total_rows"),
        outliers.alias("outliers"),
        (ratio(outliers, total) * 100.0).alias("percentage"),
    )


def equal_weight(df: DataFrame, columns: list[str], keys: list[str] = ["o", "d", "time"]) -> DataFrame:
    """Mean of each column per origin, destination and time, complete rows only."""
    means = df.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])
    return means.dropna(subset=columns)


def box_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count per group."""
    quartiles = checkpoint(exact_quantiles(df, keys, column, [0.25, 0.5, 0.75]))
    reach = (F.col("q75") - F.col("q25")) * 1.5
    value = F.col(column)
    inside = value.between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        join_unique(df.select(*keys, column), quartiles, keys, counts=quartiles.select(*keys, F.col("n").alias("_n")))
        .groupBy(*keys, "n", "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(value.isNotNull() & ~inside).alias("fliers"),
        )
    )


def uses_bridge(df: DataFrame, keys: list[str] = ["o", "d"]) -> DataFrame:
    """Whether any trip of the group crosses a bridge, and how many bridges do."""
    return (
        df.groupBy(*keys).agg(F.countDistinct("bridge").alias("bridges"))
        .withColumn("uses_bridge", F.col("bridges") > 0)
    )


def city_daily(df: DataFrame) -> DataFrame:
    """Mean speed and congestion index per origin city and day."""
    return df.groupBy("o", "date").agg(
        F.avg("speed").alias("avg_speed"), F.avg("ci").alias("avg_ci"), F.count(F.lit(1)).alias("trips")
    )


def consolidate(
    visited: DataFrame, unvisited: DataFrame, last_slot: float = 5.75, bounds=INGEST_PERIODS
) -> DataFrame:
    """One trip store from processed day files and raw trip files.

    Columns missing on one side become null, ``fid`` -1 where unknown; off-cadence
    night slots and the constant ``strategy`` column are dropped.
    """
    both = visited.unionByName(unvisited, allowMissingColumns=True)
    digits = ids.clock_digits(F.col("tripID"))
    ints = ["duration", "travelDis", "toll_distance", "tolls", "traffic_lights"]
    shaped = both.withColumns(
        {
            "OD": ids.od_of(F.col("tripID")),
            "t": ids.hour_fraction(digits),
            "time": ids.at_clock(F.col("date"), digits),
            "fid": F.coalesce(F.col("fid"), F.lit(-1)).cast("bigint"),
            **{c: to_int(F.col(c)) for c in ints},
        }
    )
    return (
        add_period(shaped, "time", bounds)
        .where(calendar.on_cadence(F.col("t"), last_slot))
        .drop("strategy")
    )
