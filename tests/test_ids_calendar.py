from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corridor.constants import ANALYSIS_PERIODS, BRIDGE_NAMES, CITY_ORDER
from corridor.functions import calendar, ids, numbers, text
from corridor.operators import steps


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "step, od, day, stamp, number",
    [
        ("6063037203", "372", 20200506, datetime(2020, 5, 6, 6, 30), 3),
        ("15143511203", "112", 20200515, datetime(2020, 5, 15, 14, 35), 3),
        ("60630503", "5", 20200506, datetime(2020, 5, 6, 6, 30), 3),
        ("310015991", "9", 20200531, datetime(2020, 5, 31, 0, 15), 91),
    ],
)
def test_step_id(spark, step, od, day, stamp, number):
    rows = spark.createDataFrame([(step, od, day)], "ID string, tripID string, date int")
    row = steps.parse_step_ids(rows).first()
    assert (row.tripID, row.OD, row.date, row.timestamp, row.stepID) == (step, od, stamp.date(), stamp, number)
    assert row.t == stamp.hour + stamp.minute / 60


def test_trip_id_from_the_right(spark):
    rows = spark.createDataFrame(
        [("10630372", date(2019, 4, 1), " a ", 1000, 100), ("311445005", date(2019, 3, 31), "b", 1000, 0), ("10630372", date(2020, 1, 1), "c", 1, 1)],
        "tripID string, date date, instruction string, distance int, duration int",
    )
    found = {r.instruction: r for r in steps.parse_trip_ids(rows).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"].OD, found["a"].timestamp, found["a"].t) == (372, datetime(2019, 4, 1, 6, 30), 6.5)
    assert found["a"].speed == pytest.approx(36.0)
    assert (found["b"].OD, found["b"].speed) == (5, None)


def test_day_width(spark):
    width = ids.day_width(F.col("i"), F.col("d"))
    assert one(spark, width, i=("string", "10630372"), d=("date", date(2019, 4, 1))) == 1
    assert one(spark, width, i=("string", "110630372"), d=("date", date(2019, 4, 11))) == 2
    assert one(spark, ids.clock_after_day(F.col("i"), F.lit(2)), i=("string", "110630372")) == "0630"


def test_step_number_rules(spark):
    assert one(spark, ids.step_after_prefix(F.col("i"), F.col("t")), i=("string", "06063037203"), t=("int", 372)) == 3
    assert one(spark, ids.step_after_underscore(F.col("i")), i=("string", "372_14")) == 14
    rows = spark.createDataFrame([(1, 6.5, 10), (1, 6.5, 12), (1, 6.75, 13)], "OD int, t double, row long")
    assert sorted(r.step_id for r in steps.step_number_from_rows(rows, ["OD", "t"], "row").collect()) == [0, 0, 2]


def test_od_and_dates(spark):
    assert one(spark, ids.od_of(F.col("i")), i=("string", "60630372")) == 372
    assert one(spark, ids.parse_date(F.col("i")), i=("int", 20200506)) == date(2020, 5, 6)
    assert one(spark, ids.date_from_file_name(F.col("f")), f=("string", "/a/day_step_200506.csv")) == date(2020, 5, 6)
    assert one(spark, ids.date_from_file_name(F.col("f")), f=("string", "/a/other.csv")) is None
    assert one(spark, ids.at_clock(F.col("d"), F.lit("2575")), d=("date", date(2020, 5, 6))) is None


def test_hour_fraction_truncates_minutes(spark):
    back = ids.from_hour_fraction(F.col("d"), F.col("t"))
    assert one(spark, back, d=("date", date(2020, 5, 6)), t=("double", 6.75)) == datetime(2020, 5, 6, 6, 45)


@pytest.mark.parametrize("outside", [-1, None])
def test_period_is_right_closed(spark, outside):
    from datetime import timedelta

    bounds = [datetime.fromisoformat(b) for b in ANALYSIS_PERIODS]
    for i, b in enumerate(bounds):
        for shift, want in ((-1, i), (0, i), (1, i + 1)):
            want = want if 1 <= want <= 4 else outside
            got = one(spark, calendar.period(F.col("ts"), outside=outside), ts=("timestamp_ntz", b + timedelta(seconds=shift)))
            assert got == want, (b, shift)


def test_calendar_flags(spark):
    rows = spark.createDataFrame([(date(2019, 4, d),) for d in range(4, 9)], "d date")
    got = rows.select(calendar.is_holiday(F.col("d")), calendar.day_of_week(F.col("d")), calendar.holiday_or_weekend(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        (True, 3, True), (True, 4, True), (False, 5, True), (False, 6, True), (False, 0, False)
    ]


def test_holiday_window_is_half_open(spark):
    shown = calendar.holiday_period(F.col("ts"), F.lit(2))
    for stamp, want in (("2019-04-04 12:00:00", 5), ("2019-04-08 08:59:59", 5), ("2019-04-08 09:00:00", 2), ("2019-04-04 11:59:59", 2)):
        assert one(spark, shown, ts=("timestamp_ntz", datetime.fromisoformat(stamp))) == want


def test_weekends_clip_and_start_on_sunday(spark):
    sunday = datetime(2020, 5, 10, 9)
    spans = one(spark, calendar.weekends(F.col("a"), F.col("b")), a=("timestamp_ntz", sunday), b=("timestamp_ntz", datetime(2020, 5, 16, 6)))
    assert [(s.begin, s.finish) for s in spans] == [
        (sunday, datetime(2020, 5, 11)), (datetime(2020, 5, 16), datetime(2020, 5, 16, 6))
    ]


def test_slots():
    assert calendar.off_cadence_slots(5.75) == [n + f for n in range(6) for f in (0.25, 0.75)]
    assert calendar.off_cadence_slots(6.75)[-2:] == [6.25, 6.75]


def test_text_rules(spark):
    match = text.first_match(F.col("s"))
    assert one(spark, match, s=("string", "经港珠澳大桥转虎门大桥")) == 1
    assert one(spark, match, s=("string", "左转")) == -1
    assert one(spark, text.label(F.col("k"), BRIDGE_NAMES), k=("int", 3)) == "HZMB"
    assert one(spark, text.label(F.col("k"), BRIDGE_NAMES), k=("int", 9)) is None
    assert one(spark, text.status_code(F.col("s")), s=("string", "非常拥堵")) == 4
    assert one(spark, text.status_code(F.col("s")), s=("string", None)) == 0
    assert one(spark, text.city_rank(F.col("c"), CITY_ORDER), c=("string", "Guangzhou")) == 3


def test_numbers(spark):
    assert one(spark, numbers.speed_kmh(F.col("a"), F.col("b")), a=("int", 1000), b=("int", 0)) is None
    assert one(spark, numbers.to_int(F.col("a")), a=("string", "98000.0")) == 98000
    assert one(spark, numbers.to_int(F.col("a")), a=("string", "n/a")) is None
