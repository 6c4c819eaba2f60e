"""Jobs that chain the operators from raw files to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor import schemas
from corridor.constants import SHORT_NAMES, STEP_COLUMNS
from corridor.functions import ids
from corridor.functions.numbers import speed_kmh
from corridor.operators import frames, heat, paths, quality, spatial, steps, trips
from corridor.operators.paths import PathStore
from corridor.scratch import checkpoint
from corridor.sources import sinks, tables
from corridor.streaming import day_batches


def trip_day(features: DataFrame, csv: DataFrame, store: PathStore, check: bool = True) -> DataFrame:
    """Trip rows with path id, for line features and their CSV sibling; new lines go to ``store``.

    Both frames carry ``date`` and ``row_idx``. With ``check`` the job stops if the
    siblings disagree in length, duration or distance.
    """
    ints = ["OD", "duration", "travelDis", "toll_distance", "traffic_lights"]
    named = features.withColumnsRenamed({"tripID": "OD", **SHORT_NAMES})
    whole = checkpoint(paths.keyed(frames.cast_ints(named, [c for c in ints if c in named.columns])))
    position, compared = ["date", "row_idx"], ["duration", "travelDis"]
    if check:
        sibling = frames.cast_ints(csv.select(*position, "tripID", *compared), compared)
        joined = frames.checked_join(whole.drop("coords"), sibling, position, compared)
    else:
        joined = frames.positional_join(whole.drop("coords"), csv.select(*position, "tripID"), position)
    digits = ids.clock_digits(F.col("tripID"))
    return paths.match(joined, store.add(whole, has_key=True), how="inner").withColumn("t", ids.hour_fraction(digits))


def step_day(features: DataFrame, csv: DataFrame, store: PathStore, check: bool = True) -> DataFrame:
    """Step rows in their fixed column order, for step features and their CSV sibling."""
    ints = ["OD", "distance", "duration", "tolls"]
    named = checkpoint(paths.keyed(frames.cast_ints(features.withColumnRenamed("tripID", "OD"), ints)))
    position, compared = ["date", "row_idx"], ["distance", "duration"]
    own = named.select(*position, "ID", "OD", *paths.KEY)
    rows = csv.select(*position, *[c for c in csv.columns if c in {"tripID", *STEP_COLUMNS} and c not in {*position, "ID", "OD"}])
    if check:
        joined, lines = frames.checked_join(named.select(*own.columns, *compared), rows, position, compared, theirs=True), named
    else:
        joined, lines = frames.positional_join(own, rows, position), named.join(csv.select(*position), position, "left_semi")
    found = paths.match(joined, store.add(lines, has_key=True))
    width = ids.day_width(F.col("ID"), F.col("date"))
    shaped = found.withColumns(
        {
            "step_id": ids.step_after_underscore(F.col("tripID")),
            "t": ids.hour_fraction(ids.clock_after_day(F.col("ID"), width)),
        }
    ).drop("tripID").withColumnRenamed("ID", "tripID")
    return shaped.select(*STEP_COLUMNS)


def step_day_without_lines(csv: DataFrame) -> DataFrame:
    """Step rows of the eras that have no line features: ``fid`` is null."""
    trip = F.col("tripID").cast("string")
    width = ids.day_width(trip, F.col("date"))
    timed = csv.withColumns(
        {"OD": ids.od_of(F.col("tripID")), "t": ids.hour_fraction(ids.clock_after_day(trip, width))}
    )
    numbered = steps.step_number_from_rows(timed, ["date", "OD", "t"], "row_idx")
    return numbered.withColumn("fid", F.lit(None).cast("bigint")).select(*STEP_COLUMNS)


def old_step_day(features: DataFrame, store: PathStore) -> DataFrame:
    """Step features with day, time, step number, path id and speed."""
    found = paths.lookup(features, store.add(features)).withColumnRenamed("fid", "path_id")
    shaped = found.withColumns(
        {
            "day": F.substring("ID", 1, 2), "time": F.substring("ID", 3, 4),
            "step_id": ids.step_after_prefix(F.col("ID"), F.col("tripID")),
            "speed": speed_kmh(F.col("distance"), F.col("duration")),
        }
    )
    return shaped.drop("coords")


def segment_day(features: DataFrame, store: PathStore) -> DataFrame:
    """Traffic segments with path id and narrow types."""
    whole = features.withColumns(
        {"lineID": F.col("lineID").try_cast("bigint"), "tripID": F.col("tripID").try_cast("bigint")}
    )
    whole = frames.cast_ints(whole, ["distance", "status"])
    found = paths.lookup(whole, store.add(whole)).withColumnRenamed("fid", "path_id").drop("coords")
    return frames.narrow_types(found)


def steps_to_parquet(merged: DataFrame, path: str) -> DataFrame:
    """Merged step rows to parsed, period-marked, date-partitioned Parquet, read back."""
    parsed = frames.compose(merged, [steps.parse_step_ids, steps.add_step_period])
    sinks.write_by_date(parsed, path)
    return merged.sparkSession.read.parquet(path)


def batch_days(
    spark: SparkSession, landing: str, out: str, marks: str, schema: str = f"ID string, fid bigint, {schemas.STEPS}", after_write=None, **more
) -> None:
    """All step files that have arrived in ``landing`` to parsed, period-marked rows by date and file.

    Bad files are set aside with an outcome and the run goes on; a repeated run writes nothing twice.
    """
    def shape(rows: DataFrame) -> DataFrame:
        dated = rows.withColumn("date", F.date_format("date", "yyyyMMdd").cast("int"))
        return frames.compose(dated, [steps.parse_step_ids, steps.add_step_period])

    day_batches.run_day_batches(spark, landing, out, marks, schema, shape, after_write=after_write, **more)


def step_csv_to_parquet(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Step CSV files with an int date column to date-partitioned Parquet, read back."""
    rows = tables.read_csv(spark, folder, f"date string, {schemas.STEPS}")
    sinks.write_by_date(rows.withColumn("date", ids.parse_date(F.col("date"))), path)
    return spark.read.parquet(path)


def merge_day(lines: DataFrame, csv: DataFrame) -> DataFrame:
    """Step lines with the columns only their CSV sibling has."""
    return frames.positional_join(lines, csv, ["date", "row_idx"])


def bridge_series(early: DataFrame, late: DataFrame, bounds=None, last_slot: float = 6.75) -> DataFrame:
    """Congestion index per bridge and poll over both eras.

    ``early`` carries trip ids to parse, ``late`` parsed steps; the highest speed
    of a bridge is taken over both.
    """
    def mean_speed(df: DataFrame) -> DataFrame:
        return frames.compose(
            df, [lambda f: steps.add_step_period(f, bounds), steps.on_bridges, steps.bridge_speed]
        )

    later = late.withColumn("speed", speed_kmh(F.col("distance"), F.col("duration"))).drop("period")
    both = checkpoint(mean_speed(early).unionByName(mean_speed(later)))
    return steps.drop_off_cadence(steps.bridge_congestion(both), last_slot)


def enrich_trips(store: DataFrame, dictionary: DataFrame, shapes: DataFrame, poi: DataFrame, bounds=None) -> DataFrame:
    """Trips with bridge, origin, destination, period and congestion index."""
    crossed = spatial.join_polygons(dictionary, shapes, "fid").where("bridge is not null")
    per_path = checkpoint(crossed.groupBy("fid").agg(F.collect_set("bridge").alias("bridges")))  # at most all bridges
    named = frames.join_unique(store.drop("OD", "period", "bridge"), per_path, ["fid"], "left")
    joined = named.withColumn("bridge", F.explode_outer("bridges")).drop("bridges")
    return frames.compose(
        trips.add_od(joined, poi), [lambda f: trips.add_period(f, "time", bounds), trips.congestion_index]
    )


def prepare_day(day: DataFrame, dictionary: DataFrame, poi: DataFrame) -> DataFrame:
    """One day of trips with names and lines, ready to draw."""
    return paths.with_lines(trips.add_od(day.drop("OD"), poi), dictionary, ("coords", "length"))


def _mapped(freq: DataFrame, dictionary: DataFrame, od: int, period: int) -> DataFrame:
    """The path frequencies of one OD and period with their lines, null where there is none."""
    used = freq.where((F.col("OD") == od) & (F.col("period") == period)).withColumn("freq", F.col("nums").cast("double"))
    return paths.with_lines(used, dictionary, ("coords", "_wkt"), "left")


def unmapped(freq: DataFrame, dictionary: DataFrame, od: int, period: int) -> DataFrame:
    """``(fid, freq)`` of the paths of one OD and period that have no line; a null ``fid`` is one of them."""
    return _mapped(freq, dictionary, od, period).where("coords is null").select("fid", "freq")


def od_heat_map(freq: DataFrame, dictionary: DataFrame, od: int, period: int, fine: bool = False, cap: float | None = None) -> DataFrame:
    """Merged step heat map of one OD and period, by whole step lines or by segments.

    ``unmapped`` returns what the map cannot show: the frequencies of paths without a line.
    """
    lines = checkpoint(_mapped(freq, dictionary, od, period).where("coords is not null"))
    merged = heat.merge_equal_edges(lines, "fid", cap=cap)
    if not fine:
        return merged
    return heat.merge_fine(merged.select("coords", "freq"), cap=cap)


def steps_on_bridges(rows: DataFrame, dictionary: DataFrame, shapes: DataFrame) -> DataFrame:
    """Distinct step rows whose line meets a bridge."""
    crossed = spatial.join_polygons(dictionary, shapes, "fid").where("bridge is not null")
    return frames.semi_distinct(rows, crossed, ["fid"])


def check_steps(rows: DataFrame) -> dict[str, DataFrame]:
    """The four step reports: top steps and the counts by time, step and date."""
    return {
        "top": quality.top_steps(rows, "stepID", ["tripID"]),
        **{key: quality.counts_by(rows, key, "road") for key in ("t", "stepID", "date")},
    }
