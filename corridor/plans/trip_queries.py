"""Queries on trips: ids, calendar, enrichment, congestion, shares and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.constants import CITY_ORDER
from corridor.functions import calendar, ids
from corridor.functions.geometry import haversine
from corridor.operators import folds, frames, quality, trips
from corridor.plans import views as V
from corridor.plans.registry import query

KEYS = ["k1", "k2", "k3", "k4"]
K = ", ".join(KEYS)
SLOT_LIST = ", ".join(str(t) for t in calendar.off_cadence_slots(5.75))
DUCK_ORDER = "[" + ", ".join(f"'{c}'" for c in CITY_ORDER) + "]"
HOLIDAY_TEST = ["1998-04-04", "1998-04-05"]


def _poi(spark, folder):
    return V.poi(spark, folder).withColumnRenamed("id", "OD")


def duck_haversine(lon0, lat0, lon1, lat1, radius):
    return (
        f"2 * {radius}::DOUBLE * asin(sqrt(pow(sin(radians(({lat1}) - ({lat0})) / 2), 2) + cos(radians({lat0})) "
        f"* cos(radians({lat1})) * pow(sin(radians(({lon1}) - ({lon0})) / 2), 2)))"
    )


GREAT_CIRCLE = duck_haversine("lon_0", "lat_0", "lon_1", "lat_1", 6371.0088)


@query("poi_great_circle", V.with_views("poi_v") + f"SELECT id AS OD, o, d, round({GREAT_CIRCLE}, 6) AS km FROM poi_v")
def poi_great_circle(spark, folder):
    found = trips.poi_distances(V.poi(spark, folder))
    return found.select("OD", "o", "d", F.round("great_circle_dis", 6).alias("km"))


@query(
    "haversine",
    f"""SELECT s_suppkey, round({duck_haversine('113.0::DOUBLE + s_suppkey % 90 * 0.01::DOUBLE', '22.0::DOUBLE + s_nationkey * 0.05::DOUBLE',
        '114.0::DOUBLE', '23.0::DOUBLE', 6371)} * 1000, 2) AS metres FROM supplier""",
)
def haversine_metres(spark, folder):
    lon, lat = F.expr("113.0D + s_suppkey % 90 * 0.01D"), F.expr("22.0D + s_nationkey * 0.05D")
    km = haversine(lon, lat, F.lit(114.0), F.lit(23.0), 6371.0)
    return V.table(spark, folder, "supplier").select("s_suppkey", F.round(km * 1000, 2).alias("metres"))


@query("od_mod", V.with_views("trips_v") + f"SELECT {K}, od AS OD FROM trips_v")
def od_mod(spark, folder):
    return V.trips(spark, folder).select(*KEYS, ids.od_of(F.col("tripID")).alias("OD"))


@query(
    "hour_fraction",
    V.with_views("trips_v") + f"SELECT {K}, round(t, 6) AS t, {V.duck_stamp('time')} AS stamp FROM trips_v",
)
def hour_fraction(spark, folder):
    rows = V.trips(spark, folder).withColumn("t", ids.hour_fraction(ids.clock_digits(F.col("tripID"))))
    stamped = rows.withColumn("stamp", ids.from_hour_fraction(F.col("date"), F.col("t")))
    return stamped.selectExpr(*KEYS, "round(t, 6) as t", f"{V.stamp('stamp')} as stamp")


@query(
    "period_cut",
    V.with_views("trips_v") + f"SELECT {K}, {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} AS period FROM trips_v",
)
def period_cut(spark, folder):
    return trips.add_period(V.trips(spark, folder), "time", V.TRIP_PERIODS).select(*KEYS, "period")


@query(
    "calendar_flags",
    V.with_views("trips_v") + f"""SELECT {K}, (isodow(time) - 1)::INTEGER AS dayofweek, date IN (DATE '1998-04-04', DATE '1998-04-05') AS holiday,
        (date IN (DATE '1998-04-04', DATE '1998-04-05') OR isodow(time) >= 6) AS holiday_or_weekend FROM trips_v""",
)
def calendar_flags(spark, folder):
    flagged = trips.add_calendar(V.trips(spark, folder), "time", HOLIDAY_TEST)
    return flagged.select(*KEYS, "dayofweek", "holiday", "holiday_or_weekend")


@query("slot_filter", V.with_views("trips_v") + f"SELECT {K}, t FROM trips_v WHERE t NOT IN ({SLOT_LIST})")
def slot_filter(spark, folder):
    return V.trips(spark, folder).where(calendar.on_cadence(F.col("t"))).select(*KEYS, "t")


@query(
    "safe_casts",
    """SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 10 = 0 THEN 'n/a' ELSE p_size::VARCHAR END AS INTEGER) AS size_text,
        trunc(p_retailprice)::INTEGER AS price FROM part""",
)
def safe_casts(spark, folder):
    rows = V.table(spark, folder, "part").selectExpr(
        "p_partkey", "case when p_size % 10 = 0 then 'n/a' else cast(p_size as string) end as size_text", "p_retailprice as price"
    )
    return frames.cast_ints(rows, ["size_text", "price"])


@query(
    "od_enrich",
    V.with_views("od_trips_v") + f"""SELECT {K}, od AS OD, o, d, list_position({DUCK_ORDER}, o)::BIGINT AS o_rank,
        list_position({DUCK_ORDER}, d)::BIGINT AS d_rank, round(speed::FLOAT::DOUBLE, 4) AS speed FROM od_trips_v""",
)
def od_enrich(spark, folder):
    found = trips.add_od(V.trips(spark, folder).drop("od"), _poi(spark, folder))
    return found.select(*KEYS, "OD", "o", "d", "o_rank", "d_rank", F.round(F.col("speed").cast("double"), 4).alias("speed"))


@query(
    "od_filter",
    V.with_views("od_trips_v") + f"SELECT {K}, o, d, travelDis FROM od_trips_v WHERE o = 'Guangzhou' AND d = 'Shenzhen' AND travelDis > 1000",
)
def od_filter(spark, folder):
    chosen = trips.by_od(V.od_trips(spark, folder), "Guangzhou", 3)
    return trips.by_predicate(chosen, "travelDis > 1000").select(*KEYS, "o", "d", "travelDis")


@query(
    "circuity",
    V.with_views("od_trips_v") + f"""SELECT {K}, round(travelDis / 1000.0::DOUBLE / km, 6) AS circuity_factor
        FROM od_trips_v JOIN (SELECT o, d, {GREAT_CIRCLE} AS km FROM poi_v) USING (o, d)""",
)
def circuity(spark, folder):
    found = trips.circuity(V.od_trips(spark, folder), V.poi(spark, folder))
    return found.select(*KEYS, F.round("circuity_factor", 6).alias("circuity_factor"))


CI_SQL = "SELECT *, max(speed) OVER (PARTITION BY od) / speed AS ci FROM od_trips_v"


@query("ci_od", V.with_views("od_trips_v") + f"SELECT {K}, od AS OD, round(ci, 6) AS ci FROM ({CI_SQL})")
def ci_od(spark, folder):
    return trips.congestion_index(V.od_trips(spark, folder)).select(*KEYS, "OD", F.round("ci", 6).alias("ci"))


@query(
    "city_daily",
    V.with_views("od_trips_v") + f"""SELECT o, date::VARCHAR AS day, round(avg(speed), 6) AS avg_speed, round(avg(ci), 6) AS avg_ci,
        count(*) AS trips FROM ({CI_SQL}) GROUP BY o, date""",
)
def city_daily(spark, folder):
    daily = trips.city_daily(trips.congestion_index(V.od_trips(spark, folder)))
    return daily.select(
        "o", F.col("date").cast("string").alias("day"), F.round("avg_speed", 6).alias("avg_speed"),
        F.round("avg_ci", 6).alias("avg_ci"), "trips",
    )


SHARES = f"""
    SELECT o, d, period, bridge, n AS trips, n / sum(n) OVER (PARTITION BY o, d, period) AS percentage
    FROM (SELECT o, d, {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} AS period, bridge, count(*) AS n
          FROM od_trips_v GROUP BY ALL) WHERE bridge IS NOT NULL AND period IS NOT NULL"""
BRIDGES = ["Humen bridge", "Nanshan bridge", "HZMB"]


def _period_trips(spark, folder):
    return trips.add_period(V.od_trips(spark, folder), "time", V.TRIP_PERIODS)


@query("bridge_share", V.with_views("od_trips_v") + f"SELECT o, d, period, bridge, trips, round(percentage, 6) AS percentage FROM ({SHARES})")
def bridge_share(spark, folder):
    shares = trips.bridge_share(_period_trips(spark, folder))
    return shares.select("o", "d", "period", "bridge", "trips", F.round("percentage", 6).alias("percentage"))


CELLS = [(b, p) for b in BRIDGES for p in (1, 2, 3, 4)]
PIVOTED = ", ".join(
    f"round(avg(percentage) FILTER (bridge = '{b}' AND period = {p}), 6) AS \"{b.replace(' ', '_')}_{p}\"" for b, p in CELLS
)


@query("bridge_share_pivot", V.with_views("od_trips_v") + f"SELECT o, d, {PIVOTED} FROM ({SHARES}) GROUP BY o, d")
def bridge_share_pivot(spark, folder):
    wide = trips.bridge_share_pivot(_period_trips(spark, folder), BRIDGES, [1, 2, 3, 4])
    cells = [F.round(F.col(f"{b}_{p}"), 6).alias(f"{b.replace(' ', '_')}_{p}") for b, p in CELLS]
    return wide.select("o", "d", *cells)


OUTLIERS = """
    SELECT t.*, coalesce(speed BETWEEN low AND high, false) AS kept FROM od_trips_v t LEFT JOIN (
        SELECT od, fid, round(avg(speed) - 1.2::DOUBLE * stddev_samp(speed), 9) AS low,
            round(avg(speed) + 1.2::DOUBLE * stddev_samp(speed), 9) AS high FROM od_trips_v GROUP BY od, fid
    ) b ON t.od = b.od AND t.fid = b.fid"""


def _outlier_columns(df):
    return df.select(*KEYS, "speed")


@query("outlier_kept", V.with_views("od_trips_v") + f"SELECT {K}, speed FROM ({OUTLIERS}) WHERE kept")
def outlier_kept(spark, folder):
    return _outlier_columns(trips.split_outliers(V.od_trips(spark, folder), ["OD", "fid"], "speed", 1.2)[0])


@query("outlier_dropped", V.with_views("od_trips_v") + f"SELECT {K}, speed FROM ({OUTLIERS}) WHERE NOT kept")
def outlier_dropped(spark, folder):
    return _outlier_columns(trips.split_outliers(V.od_trips(spark, folder), ["OD", "fid"], "speed", 1.2)[1])


@query(
    "outlier_share",
    V.with_views("od_trips_v") + f"""SELECT count(*) AS total_rows, count(*) FILTER (NOT kept) AS outliers,
        round(count(*) FILTER (NOT kept) / count(*) * 100, 6) AS percentage FROM ({OUTLIERS})""",
)
def outlier_share(spark, folder):
    share = trips.outlier_share(V.od_trips(spark, folder), ["OD", "fid"], "speed", 1.2)
    return share.select("total_rows", "outliers", F.round("percentage", 6).alias("percentage"))


@query(
    "equal_weight",
    V.with_views("od_trips_v") + f"""SELECT o, d, {V.duck_stamp('time')} AS stamp, round(avg(speed), 6) AS speed, round(avg(travelDis), 6) AS travelDis
        FROM od_trips_v GROUP BY o, d, time HAVING avg(speed) IS NOT NULL""",
)
def equal_weight(spark, folder):
    means = trips.equal_weight(V.od_trips(spark, folder), ["speed", "travelDis"])
    return means.selectExpr("o", "d", f"{V.stamp('time')} as stamp", "round(speed, 6) as speed", "round(travelDis, 6) as travelDis")


@query(
    "box_summary",
    V.with_views("od_trips_v") + f"""
    SELECT o, d, period, n, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
        min(cf) FILTER (cf BETWEEN low AND high) AS whisker_low, max(cf) FILTER (cf BETWEEN low AND high) AS whisker_high,
        count(*) FILTER (NOT cf BETWEEN low AND high) AS fliers
    FROM (SELECT *, q25 - 1.5 * (q75 - q25) AS low, q75 + 1.5 * (q75 - q25) AS high
          FROM (SELECT o, d, coalesce(period, 0) AS period, travelDis::DOUBLE AS cf,
                  count(*) OVER w AS n, quantile_cont(travelDis::DOUBLE, 0.25) OVER w AS q25,
                  quantile_cont(travelDis::DOUBLE, 0.5) OVER w AS q50, quantile_cont(travelDis::DOUBLE, 0.75) OVER w AS q75
                FROM (SELECT *, {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} AS period FROM od_trips_v)
                WINDOW w AS (PARTITION BY o, d, coalesce(period, 0))))
    GROUP BY o, d, period, n, q25, q50, q75""",
)
def box_summary(spark, folder):
    rows = _period_trips(spark, folder).selectExpr("o", "d", "coalesce(period, 0) as period", "cast(travelDis as double) as distance")
    box = trips.box_summary(rows, ["o", "d", "period"], "distance")
    rounded = {q: F.round(q, 6) for q in ("q25", "q50", "q75")}
    return box.withColumns(rounded).select("o", "d", "period", "n", "q25", "q50", "q75", "whisker_low", "whisker_high", "fliers")


@query(
    "od_uses_bridge",
    V.with_views("od_trips_v") + f"""SELECT o, d, period, count(DISTINCT bridge) AS bridges, count(DISTINCT bridge) > 0 AS uses_bridge
        FROM (SELECT *, {V.duck_period('time', V.TRIP_PERIODS, '-1')} AS period FROM od_trips_v) GROUP BY o, d, period""",
)
def od_uses_bridge(spark, folder):
    rows = trips.add_period(V.od_trips(spark, folder), "time", V.TRIP_PERIODS, outside=-1)
    return trips.uses_bridge(rows, ["o", "d", "period"]).select("o", "d", "period", "bridges", "uses_bridge")


@query(
    "union_trips",
    V.with_views("trips_v") + f"""SELECT {K}, od AS OD, t, {V.duck_stamp('time')} AS stamp,
        CASE WHEN date < DATE '1999-01-01' THEN coalesce(fid, -1) ELSE -1 END AS fid,
        {V.duck_period('time', V.TRIP_PERIODS, 'NULL')} AS period, duration, travelDis, 7 AS tolls
        FROM trips_v WHERE t NOT IN ({SLOT_LIST})""",
)
def union_trips(spark, folder):
    extra = ["'3' as toll_distance", "'7' as tolls", "2.0D as traffic_lights"]
    rows = V.trips(spark, folder).selectExpr(*KEYS, "date", "tripID", "fid", "duration", "travelDis", *extra)
    visited = rows.where("date < date'1999-01-01'")
    unvisited = rows.where("date >= date'1999-01-01'").drop("fid").withColumn("strategy", F.lit("fastest"))
    store = trips.consolidate(visited, unvisited, 5.75, V.TRIP_PERIODS)
    return store.selectExpr(*KEYS, "OD", "t", f"{V.stamp('time')} as stamp", "fid", "period", "duration", "travelDis", "tolls")


@query(
    "status_ratio",
    "SELECT l_orderkey, l_partkey, " + ", ".join(
        f"round(sum(CASE WHEN l_linenumber % 5 = {i} THEN l_quantity ELSE 0 END) / max(l_extendedprice), 6) AS {name}"
        for i, name in enumerate(["unknown", "smooth", "slow", "congested", "verycongested"])
    ) + " FROM lineitem GROUP BY l_orderkey, l_partkey",
)
def status_ratio(spark, folder):
    parts = V.table(spark, folder, "lineitem").withColumn("status", F.expr("l_linenumber % 5"))
    shares = quality.status_ratios(parts, ["l_orderkey", "l_partkey"], "status", "l_quantity", "l_extendedprice")
    names = ["unknown", "smooth", "slow", "congested", "verycongested"]
    return shares.select("l_orderkey", "l_partkey", *[F.round(n, 6).alias(n) for n in names])


NARROW = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey",
    "l_linenumber": "l_linenumber", "l_quantity": "l_quantity",
}


@query(
    "narrow_types",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, CASE {"WHEN min(" + c + ") > -128 AND max(" + c + ") < 127 THEN 'tinyint' "
            "WHEN min(" + c + ") > -32768 AND max(" + c + ") < 32767 THEN 'smallint' "
            "WHEN min(" + c + ") > -2147483648 AND max(" + c + ") < 2147483647 THEN 'int' ELSE 'bigint' END" if c != 'l_quantity'
            else "WHEN true THEN 'float' END"} AS column_type, sum({c})::DOUBLE AS total FROM lineitem"""
        for c in NARROW
    ),
)
def narrow_types(spark, folder):
    narrow = frames.narrow_types(V.table(spark, folder, "lineitem").select(*NARROW))
    kinds = dict(narrow.dtypes)
    totals = narrow.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in NARROW])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("column_type"), F.col(c).alias("total")) for c in NARROW
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def _kmh(piece):
    return piece.assign(kmh=piece["travelDis"] / piece["duration"].where(piece["duration"] > 0) * 3.6).drop(
        columns=["travelDis", "duration"]
    )


@query(
    "apply_by_group",
    V.with_views("trips_v") + f"SELECT {K}, round(kmh, 6) AS kmh FROM (SELECT *, CASE WHEN duration > 0 THEN travelDis / duration * 3.6::DOUBLE END AS kmh FROM trips_v)",
)
def apply_by_group(spark, folder):
    rows = V.trips(spark, folder).select(*KEYS, "travelDis", "duration")
    schema = "k1 bigint, k2 int, k3 bigint, k4 bigint, kmh double"
    return frames.apply_in_pieces(rows, _kmh, schema).withColumn("kmh", F.round("kmh", 6))


@query(
    "regress_by_od",
    V.with_views("trips_v") + """SELECT OD, count(duration + travelDis) AS n, round(regr_slope(travelDis, duration), 6) AS slope,
        round(regr_intercept(travelDis, duration), 4) AS intercept, round(regr_r2(travelDis, duration), 6) AS r2
        FROM (SELECT * EXCLUDE (od), CASE WHEN k3 % 10 > 0 THEN 0 WHEN od < 28 THEN od END AS OD FROM trips_v) GROUP BY OD""",
)
def regress_by_od(spark, folder):
    """Distance on duration per OD; nine tenths of the trips are of one OD, and some have none."""
    rows = V.trips(spark, folder).selectExpr("case when k3 % 10 > 0 then 0 when od < 28 then od end as OD", "duration", "travelDis")
    found = folds.apply_by_group(rows, ["OD"], folds.regression("duration", "travelDis"), "n bigint, slope double, intercept double, r2 double")
    return found.select("OD", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))
