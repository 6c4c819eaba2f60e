"""Queries on steps: id parsing, bridge series, frequencies and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.constants import BRIDGE_NAMES
from corridor.functions import calendar, ids, text
from corridor.functions.numbers import speed_kmh
from corridor.operators import frames, quality, steps
from corridor.plans import jobs
from corridor.plans import views as V
from corridor.plans.registry import query

PERIOD = V.duck_period("timestamp", V.EVENT_PERIODS, "-1")
KMH = "CASE WHEN duration <> 0 THEN distance::DOUBLE / duration * 3.6::DOUBLE END"
BRIDGE = (
    "CASE WHEN instruction LIKE '%虎门大桥%' THEN 1 WHEN instruction LIKE '%南沙大桥%' THEN 2 "
    "WHEN instruction LIKE '%港珠澳大桥%' THEN 3 ELSE -1 END"
)
NAME = "CASE bridge WHEN 1 THEN 'Humen bridge' WHEN 2 THEN 'Nanshan bridge' WHEN 3 THEN 'HZMB' END"
CLOCK = "(hour(timestamp) + minute(timestamp) / 60.0::DOUBLE)"
NIGHT = ", ".join(str(t) for t in calendar.off_cadence_slots(6.75))
SERIES = f"""
    SELECT *, {CLOCK} AS t, max_speed / avg_speed AS ci FROM (
        SELECT *, max(avg_speed) OVER (PARTITION BY bridge) AS max_speed FROM (
            SELECT {PERIOD} AS period, timestamp, {NAME} AS bridge, avg({KMH}) AS avg_speed
            FROM (SELECT *, {BRIDGE} AS bridge FROM steps_v) WHERE bridge > 0 GROUP BY ALL))
    WHERE {CLOCK} NOT IN ({NIGHT})"""


def _raw(spark, folder):
    """Steps as they arrive: only the ids carry time and OD."""
    return V.steps(spark, folder).drop("OD", "timestamp", "clock")


def bridge_series(spark, folder):
    early = steps.parse_trip_ids(_raw(spark, folder), V.ERA_SPLIT)
    late = V.steps(spark, folder).where(f"date >= date'{V.ERA_SPLIT}'")
    return jobs.bridge_series(early, late, V.EVENT_PERIODS)


@query(
    "ci_bridge",
    V.with_views("steps_v") + f"""SELECT period, {V.duck_stamp('timestamp')} AS stamp, bridge, round(avg_speed, 6) AS avg_speed,
        round(max_speed, 6) AS max_speed, round(ci, 6) AS ci, t FROM ({SERIES})""",
)
def ci_bridge(spark, folder):
    return bridge_series(spark, folder).selectExpr(
        "period", f"{V.stamp('timestamp')} as stamp", "bridge", "round(avg_speed, 6) as avg_speed",
        "round(max_speed, 6) as max_speed", "round(ci, 6) as ci", "t",
    )


@query(
    "parse_trip_id",
    V.with_views("steps_v") + f"""SELECT event_id, OD, {V.duck_stamp('timestamp')} AS stamp, round({CLOCK}, 6) AS t,
        trim(instruction) AS instruction, round({KMH}, 6) AS speed FROM steps_v WHERE date < DATE '{V.ERA_SPLIT}'""",
)
def parse_trip_id(spark, folder):
    return steps.parse_trip_ids(_raw(spark, folder), V.ERA_SPLIT).selectExpr(
        "event_id", "OD", f"{V.stamp('timestamp')} as stamp", "round(t, 6) as t", "instruction", "round(speed, 6) as speed"
    )


@query(
    "parse_step_id",
    V.with_views("steps_v") + f"""SELECT event_id, concat(day(date), clock, OD, lpad(stepID::VARCHAR, 2, '0')) AS tripID, OD::VARCHAR AS OD,
        date::VARCHAR AS day, {V.duck_stamp('timestamp')} AS stamp, round({CLOCK}, 6) AS t, stepID FROM steps_v""",
)
def parse_step_id(spark, folder):
    merged = _merged(spark, folder)
    return steps.parse_step_ids(merged).selectExpr(
        "event_id", "tripID", "OD", "cast(date as string) as day", f"{V.stamp('timestamp')} as stamp", "round(t, 6) as t", "stepID"
    )


def _merged(spark, folder):
    """Step rows with a composed ``ID``, an int date and the OD in ``tripID``."""
    return V.steps(spark, folder).selectExpr(
        "event_id", "concat(day(date), clock, OD, lpad(cast(stepID as string), 2, '0')) as ID",
        "cast(OD as string) as tripID", "cast(date_format(date, 'yyyyMMdd') as int) as date", "road", "fid",
    )


@query(
    "to_date_fmt",
    "SELECT event_id, (ts::DATE)::VARCHAR AS day FROM events",
)
def to_date_fmt(spark, folder):
    rows = V.table(spark, folder, "events").selectExpr("event_id", "cast(date_format(ts, 'yyyyMMdd') as int) as d")
    return rows.select("event_id", ids.parse_date(F.col("d")).cast("string").alias("day"))


@query("cal_time", V.with_views("steps_v") + f"SELECT event_id, round({CLOCK}, 6) AS t FROM steps_v")
def cal_time(spark, folder):
    width = ids.day_width(F.col("tripID"), F.col("date"))
    t = ids.hour_fraction(ids.clock_after_day(F.col("tripID"), width))
    return V.steps(spark, folder).select("event_id", F.round(t, 6).alias("t"))


@query(
    "step_number",
    V.with_views("steps_v") + """SELECT event_id, stepID AS from_prefix, stepID AS from_underscore,
        (event_id - min(event_id) OVER (PARTITION BY OD, date))::INTEGER AS from_rows FROM steps_v""",
)
def step_number(spark, folder):
    rows = V.steps(spark, folder)
    long_id = F.expr("concat(date_format(date, 'dd'), clock, OD * 100 + stepID)")
    numbered = steps.step_number_from_rows(rows, ["OD", "date"], "event_id")
    return numbered.select(
        "event_id",
        ids.step_after_prefix(long_id, F.col("OD")).alias("from_prefix"),
        ids.step_after_underscore(F.concat_ws("_", "OD", "stepID")).alias("from_underscore"),
        F.col("step_id").alias("from_rows"),
    )


@query("period_case", V.with_views("steps_v") + f"SELECT event_id, {PERIOD} AS period FROM steps_v")
def period_case(spark, folder):
    return steps.add_step_period(V.steps(spark, folder), V.EVENT_PERIODS).select("event_id", "period")


@query(
    "period_override",
    V.with_views("steps_v") + f"""SELECT event_id, CASE WHEN timestamp >= TIMESTAMP '2024-01-12 12:00:00' AND timestamp < TIMESTAMP '2024-01-15 09:00:00'
        THEN 5 ELSE {PERIOD} END AS period FROM steps_v""",
)
def period_override(spark, folder):
    rows = steps.add_step_period(V.steps(spark, folder), V.EVENT_PERIODS)
    window = ("2024-01-12 12:00:00", "2024-01-15 09:00:00")
    return rows.select("event_id", calendar.holiday_period(F.col("timestamp"), F.col("period"), window).alias("period"))


@query("classify_like", V.with_views("steps_v") + f"SELECT event_id, bridge FROM (SELECT *, {BRIDGE} AS bridge FROM steps_v) WHERE bridge > 0")
def classify_like(spark, folder):
    return steps.on_bridges(V.steps(spark, folder)).select("event_id", "bridge")


@query("map_label", V.with_views("steps_v") + f"SELECT event_id, {NAME} AS bridge FROM (SELECT *, {BRIDGE} AS bridge FROM steps_v)")
def map_label(spark, folder):
    bridge = text.label(text.first_match(F.col("instruction")), BRIDGE_NAMES)
    return V.steps(spark, folder).select("event_id", bridge.alias("bridge"))


@query("speed_kmh", V.with_views("steps_v") + f"SELECT event_id, round({KMH}, 6) AS kmh FROM steps_v")
def kmh(spark, folder):
    return V.steps(spark, folder).select("event_id", F.round(speed_kmh(F.col("distance"), F.col("duration")), 6).alias("kmh"))


@query(
    "bridge_speed",
    V.with_views("steps_v") + f"""SELECT {PERIOD} AS period, {V.duck_stamp('timestamp')} AS stamp, bridge, round(avg({KMH}), 6) AS avg_speed
        FROM (SELECT *, {BRIDGE} AS bridge FROM steps_v) WHERE bridge > 0 GROUP BY ALL""",
)
def bridge_speed(spark, folder):
    rows = V.steps(spark, folder).withColumn("speed", speed_kmh(F.col("distance"), F.col("duration")))
    series = steps.bridge_speed(steps.on_bridges(steps.add_step_period(rows, V.EVENT_PERIODS)))
    return series.selectExpr("period", f"{V.stamp('timestamp')} as stamp", "bridge", "round(avg_speed, 6) as avg_speed")


BAND = """round(avg(ci), 6) AS ci_mean,
    round(avg(ci) - coalesce(stddev_samp(ci) / sqrt(count(ci)) * 1.96::DOUBLE, 0), 6) AS ci_low,
    round(avg(ci) + coalesce(stddev_samp(ci) / sqrt(count(ci)) * 1.96::DOUBLE, 0), 6) AS ci_high, count(ci) AS n"""


def _band(df):
    return df.withColumns({c: F.round(c, 6) for c in ("ci_mean", "ci_low", "ci_high")})


@query(
    "daily_ci",
    V.with_views("steps_v") + f"""SELECT {V.duck_stamp('timestamp')} AS stamp, bridge, {BAND} FROM ({SERIES})
        WHERE period <= 2 AND NOT (timestamp >= TIMESTAMP '2024-01-06' AND timestamp < TIMESTAMP '2024-01-07') GROUP BY timestamp, bridge""",
)
def daily_ci(spark, folder):
    rows = bridge_series(spark, folder).where(
        "period <= 2 and not (timestamp >= timestamp_ntz'2024-01-06 00:00:00' and timestamp < timestamp_ntz'2024-01-07 00:00:00')"
    )
    series = _band(steps.ci_series(rows, ["timestamp", "bridge"]))
    return series.withColumn("stamp", F.expr(V.stamp("timestamp"))).drop("timestamp")


@query("ci_profile", V.with_views("steps_v") + f"SELECT t, bridge, period, {BAND} FROM ({SERIES}) GROUP BY t, bridge, period")
def ci_profile(spark, folder):
    return _band(steps.ci_series(bridge_series(spark, folder), ["t", "bridge", "period"]))


@query(
    "step_freq",
    V.with_views("steps_v") + f"""SELECT a.OD, a.period, a.fid, nums, round(nums / total, 6) AS freq FROM
        (SELECT OD, {PERIOD} AS period, fid, count(tripID) AS nums FROM steps_v GROUP BY ALL) a JOIN
        (SELECT OD, {PERIOD} AS period, count(DISTINCT timestamp) AS total FROM steps_v GROUP BY ALL) b
        ON a.OD = b.OD AND a.period = b.period""",
)
def step_freq(spark, folder):
    freq = steps.step_frequency(steps.add_step_period(V.steps(spark, folder), V.EVENT_PERIODS))
    return freq.withColumn("freq", F.round("freq", 6))


@query(
    "day_coverage",
    V.with_views("steps_v") + """SELECT instruction, road, count(DISTINCT date) AS date_count,
        string_agg(DISTINCT date::VARCHAR, ',' ORDER BY date::VARCHAR) AS dates
        FROM steps_v GROUP BY instruction, road HAVING count(DISTINCT date) > 25""",
)
def day_coverage(spark, folder):
    rows = V.steps(spark, folder).select("tripID", "instruction", "road", "date")
    found = steps.day_coverage(rows, 25)
    dates = F.array_join(F.transform("date_lst", lambda d: d.cast("string")), ",")
    return found.select("instruction", "road", "date_count", dates.alias("dates"))


@query(
    "weekend_intervals",
    """WITH span AS (SELECT min(ts) AS x0, max(ts) AS x1 FROM events),
        days AS (SELECT unnest(generate_series(x0::DATE - INTERVAL 1 DAY, x1::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d, x0, x1 FROM span)
        SELECT strftime(greatest(d, x0), '%Y-%m-%d %H:%M:%S') AS begins, strftime(least(d + INTERVAL 2 DAY, x1), '%Y-%m-%d %H:%M:%S') AS ends
        FROM days WHERE isodow(d) = 6 AND greatest(d, x0) < least(d + INTERVAL 2 DAY, x1)""",
)
def weekend_intervals(spark, folder):
    spans = steps.weekend_intervals(V.table(spark, folder, "events"), "ts")
    return spans.selectExpr(f"{V.stamp('begin')} as begins", f"{V.stamp('finish')} as ends")


@query(
    "dist_by_key",
    V.with_views("steps_v") + "\nUNION ALL\n".join(
        f"SELECT '{k}' AS key_name, {k}::VARCHAR AS key_value, count(road) AS n FROM steps_v GROUP BY {k}" for k in ("clock", "stepID", "date")
    ),
)
def dist_by_key(spark, folder):
    return quality.distributions(V.steps(spark, folder), ["clock", "stepID", "date"], "road")


@query(
    "id_length_hist",
    V.with_views("steps_v") + f"""SELECT CASE WHEN date < DATE '{V.ERA_SPLIT}' THEN 'before' ELSE 'after' END AS era, date::VARCHAR AS day,
        length(tripID)::INTEGER AS id_length, count(*) AS n FROM steps_v GROUP BY ALL""",
)
def id_length_hist(spark, folder):
    hist = quality.id_lengths(V.steps(spark, folder), "tripID", V.ERA_SPLIT)
    return hist.select("era", F.col("date").cast("string").alias("day"), "id_length", "n")


@query("topk_steps", V.with_views("steps_v") + "SELECT stepID, tripID, event_id FROM steps_v ORDER BY stepID DESC, tripID, event_id LIMIT 10")
def topk_steps(spark, folder):
    return quality.top_steps(V.steps(spark, folder).select("stepID", "tripID", "event_id"), "stepID", ["tripID", "event_id"])


@query("date_filter", V.with_views("steps_v") + "SELECT event_id, tripID, instruction FROM steps_v WHERE date = DATE '2024-01-18'")
def date_filter(spark, folder):
    return V.steps(spark, folder).where(F.col("date") == F.lit("2024-01-18").cast("date")).select("event_id", "tripID", "instruction")


@query(
    "count_reconcile",
    V.with_views("steps_v") + """SELECT a.date::VARCHAR AS day, count_x, count_y, coalesce(count_x = count_y, false) AS same FROM
        (SELECT date, count(tripID) AS count_x FROM steps_v GROUP BY date) a LEFT JOIN
        (SELECT date, count(tripID) AS count_y FROM steps_v WHERE date <> DATE '2024-01-05' AND (date <> DATE '2024-01-23' OR road IS NOT NULL)
         GROUP BY date) b USING (date)""",
)
def count_reconcile(spark, folder):
    rows = V.steps(spark, folder)
    other = rows.where("date <> date'2024-01-05' and (date <> date'2024-01-23' or road is not null)")
    return quality.reconcile_counts(rows, other, "date", "tripID").select(
        F.col("date").cast("string").alias("day"), "count_x", "count_y", "same"
    )


@query("distinct_proj", V.with_views("steps_v") + "SELECT DISTINCT road, instruction FROM steps_v")
def distinct_proj(spark, folder):
    return V.steps(spark, folder).select("road", "instruction").distinct()


@query(
    "semi_distinct",
    V.with_views("steps_v") + """SELECT DISTINCT OD, fid, instruction FROM steps_v
        WHERE fid IN (SELECT fid FROM steps_v WHERE instruction = '港珠澳大桥')""",
)
def semi_distinct(spark, folder):
    rows = V.steps(spark, folder).select("OD", "fid", "instruction")
    return frames.semi_distinct(rows, rows.where("instruction = '港珠澳大桥'"), ["fid"])


@query(
    "sym_diff",
    """SELECT node, n, sum(sign)::BIGINT AS surplus FROM (
        SELECT l_suppkey AS node, l_linenumber AS n, 1 AS sign FROM lineitem UNION ALL
        SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END, -1 FROM orders) GROUP BY node, n HAVING sum(sign) <> 0""",
)
def sym_diff(spark, folder):
    a = V.table(spark, folder, "lineitem").selectExpr("l_suppkey as node", "l_linenumber as n")
    b = V.table(spark, folder, "orders").selectExpr("o_custkey as node", "case when o_orderstatus = 'F' then 1 else 2 end as n")
    return frames.symmetric_difference(a, b)
