"""Value tests for the formula sheet: service date, rounding, classes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from transitlake.functions import core as C
from transitlake.functions import labels as L


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {v[1]}" for k, v in
                                                             zip(cols, [(0, t) for t in cols.values()])))
    return df.select(expr.alias("x")).first()["x"]


def lit_row(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("utc,expected", [
    ("2025-06-20 06:59:00", dt.date(2025, 6, 19)),   # 02:59 EDT → previous day
    ("2025-06-20 07:00:00", dt.date(2025, 6, 20)),   # 03:00 EDT → same day
    ("2025-01-15 07:59:00", dt.date(2025, 1, 14)),   # 02:59 EST
    ("2025-01-15 08:00:00", dt.date(2025, 1, 15)),   # 03:00 EST
    ("2025-03-09 06:59:00", dt.date(2025, 3, 8)),    # spring-forward day, 01:59 EST
    ("2025-03-09 07:00:00", dt.date(2025, 3, 9)),    # 03:00 EDT (02:xx does not exist)
    ("2025-11-02 06:30:00", dt.date(2025, 11, 1)),   # fall-back day, 01:30 EST? (second 01:30 EDT→EST)
    ("2025-11-02 08:00:00", dt.date(2025, 11, 2)),   # 03:00 EST
])
def test_service_date_new_york(spark, utc, expected):
    got = lit_row(spark, C.service_date(F.lit(utc).cast("timestamp"), "America/New_York"))
    assert got == expected


def test_service_seconds_after_midnight(spark):
    # 01:30 New York (EDT) = 05:30Z → 25.5 h into the service day
    got = lit_row(spark, C.service_seconds(F.lit("2025-06-20 05:30:00").cast("timestamp"), "America/New_York"))
    assert got == 25 * 3600 + 30 * 60


def test_iso_offset_instant(spark):
    got = lit_row(spark, C.to_ts(F.lit("2026-04-19T06:00:00-04:00")))
    assert got == dt.datetime(2026, 4, 19, 10, 0)


@pytest.mark.parametrize("x,d,expected", [(1.005, 2, 1.0), (1.125, 2, 1.13), (2.5, 0, 3.0), (-2.5, 0, -3.0),
                                          (0.05, 1, 0.1), (-0.04, 1, 0.0), (8.333333, 2, 8.33)])
def test_round_half_away(spark, x, d, expected):
    got = lit_row(spark, C.round_half_away(F.lit(x), d))
    assert got == expected
    assert str(got) != "-0.0"


@pytest.mark.parametrize("delay,cat,late,sig", [
    (-1801, "early", False, False), (-1800, "early", False, False), (-60, "early", False, False),
    (-59, "on_time", False, False), (60, "on_time", False, False), (61, "slightly_late", True, False),
    (300, "slightly_late", True, False), (301, "late", True, True), (600, "late", True, True),
    (601, "very_late", True, True), (3600, "very_late", True, True), (None, "unknown", False, False)])
def test_delay_category(spark, delay, cat, late, sig):
    df = spark.createDataFrame([(delay,)], "d long")
    r = df.select(L.delay_category("d").alias("c"), F.coalesce(F.col("d") > 60, F.lit(False)).alias("l"),
                  F.coalesce(F.col("d") > 300, F.lit(False)).alias("s")).first()
    assert (r["c"], r["l"], r["s"]) == (cat, late, sig)


def test_labels(spark):
    df = spark.createDataFrame([(1, 1, None), (3, 0, 2), (9, None, 7)], "rt int, lt int, vt int")
    r = df.select(L.route_type_desc("rt").alias("a"), L.location_type_desc("lt").alias("b"),
                  L.vehicle_type_desc("vt").alias("c")).collect()
    assert [tuple(x) for x in r] == [("Heavy Rail", "Station", None), ("Bus", "Stop/Platform", "Commuter Rail"),
                                     ("Unknown", "Unknown", "Unknown")]


def test_time_period_and_severity(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 9, 10, 15, 16, 19, 20, 23, 0)], "h int")
    got = [r[0] for r in df.select(L.time_period("h")).collect()]
    assert got == ["overnight", "morning_rush", "morning_rush", "midday", "midday", "evening_rush",
                   "evening_rush", "evening", "evening", "overnight"]
    sev = spark.createDataFrame([(s,) for s in (7, 4, 2, 1, 0, None)], "s int")
    assert [r[0] for r in sev.select(L.severity_category("s", "mart")).collect()] == \
        ["critical", "major", "minor", "informational", "informational", "informational"]
    assert [r[0] for r in sev.select(L.severity_category("s", "live")).collect()] == \
        ["critical", "major", "minor", "minor", "info", "info"]


def test_weather_condition_variants(spark):
    df = spark.createDataFrame([(0,), (1,), (51,), (99,), (42,)], "c int")
    assert [r[0] for r in df.select(L.weather_condition("c")).collect()] == \
        ["Clear", "Cloudy", "Drizzle", "Thunderstorm", "Unknown"]
    assert [r[0] for r in df.select(L.weather_condition("c", "current")).collect()][:2] == ["Clear", "Clear"]
