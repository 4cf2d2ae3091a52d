"""Quality suites (FIXTURES §3: null key, empty frame, range, valid day)."""

import datetime as dt

from tests.conftest import SF_SMALL
from transitlake.operators import quality as Q
from transitlake.sources import schemas as S


def result(df, check):
    return {r["check"]: r for r in df.collect()}[check]


def test_null_key_fails(spark):
    rows = [(None if i % 2 else f"r{i}", "n", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "route_id string, long_name string, route_type int")
    r = result(Q.validate(df, "routes"), "not_null:route_id")
    assert r["passed"] is False and r["actual"] == "100" and r["details"] == "50.0% null"


def test_empty_frame_fails(spark):
    df = spark.createDataFrame([], S.ROUTES)
    res = Q.validate(df, "routes")
    assert result(res, "not_empty")["passed"] is False
    summary = Q.summarize(res).first()
    assert summary["success"] is False


def test_range_fails(spark):
    df = spark.createDataFrame([("s1", "n", 99.0, -71.0)], "stop_id string, name string, latitude double, longitude double")
    r = result(Q.validate(df, "stops"), "valid_range:latitude")
    assert r["passed"] is False and r["actual"] == "[99.0, 99.0]"


def test_valid_weather_day_passes(spark):
    rows = [(f"2025-06-20T{h:02d}:00", 20.0, 50.0, 0.0, 0.0, 0.0, 10.0, 15.0, 20000.0, 0) for h in range(24)]
    res = Q.validate(spark.createDataFrame(rows, S.WEATHER), "weather")
    assert Q.summarize(res).first()["success"] is True


def test_uniqueness_counts_null_as_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "trip_id string")
    r = result(Q.validate(df, "trips"), "unique:trip_id")
    assert r["actual"] == "2" and r["passed"] is False


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 6, 20, 12, 0),)], "extracted_at timestamp")
    ok = Q.freshness({"predictions": df}, "2025-06-20 12:20:00").first()
    late = Q.freshness({"predictions": df}, "2025-06-20 13:00:00").first()
    assert ok["passed"] is True and late["passed"] is False


def test_readable_reports_failure(spark, tmpdir_path):
    r = Q.readable(spark, "routes", f"{tmpdir_path}/missing").first()
    assert r["passed"] is False


def test_freshness_of_every_table_and_of_empty_ones(spark):
    from transitlake.plans import registry
    from transitlake.plans.models import Models
    from transitlake.sources.proxy import RawTables

    raw = RawTables(spark, SF_SMALL)
    job = registry.model_functions()["p9_freshness"]
    got = {r["entity"]: r for r in job(Models(raw)).collect()}
    assert set(got) == {"routes", "stops", "predictions", "vehicles", "alerts", "weather"}
    assert got["routes"]["passed"] and got["stops"]["actual"] == "11.5"
    raw.stops = raw.stops.limit(0)
    empty = {r["entity"]: r for r in job(Models(raw)).collect()}["stops"]
    assert empty["actual"] == "missing" and not empty["passed"]
