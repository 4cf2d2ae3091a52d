"""Landed document parsing (FIXTURES §3: flatten, null relation, empty,
labels, first stop, occupancy, alert, weather)."""

import datetime as dt
import json

from pyspark.sql import functions as F

from transitlake.sources import documents as D


def load(spark, tmp, entity, doc):
    p = f"{tmp}/{entity}.json"
    with open(p, "w") as f:
        json.dump(doc, f)
    return D.read_documents(spark, p, entity, extracted_at="2025-06-20T14:30:00+00:00")


def res(i, attrs, rels=None, typ="route"):
    r = {"id": i, "type": typ, "attributes": attrs}
    if rels is not None:
        r["relationships"] = rels
    return r


def test_routes_flatten_labels_and_empty_string(spark, tmpdir_path):
    doc = {"data": [res("Red", {"long_name": "Red Line", "short_name": "", "type": 1, "color": "DA291C"},
                        {"line": {"data": {"id": "line-Red", "type": "line"}}}),
                    res("1", {"long_name": "Bus 1", "short_name": "1", "type": 3}, {"line": {"data": None}})]}
    rows = {r["route_id"]: r for r in load(spark, tmpdir_path, "routes", doc).collect()}
    assert rows["Red"]["route_type"] == 1 and rows["Red"]["route_type_desc"] == "Heavy Rail"
    assert rows["Red"]["line_id"] == "line-Red" and rows["Red"]["short_name"] is None
    assert rows["1"]["line_id"] is None and rows["1"]["route_type_desc"] == "Bus"


def test_stops_null_parent_and_codes(spark, tmpdir_path):
    doc = {"data": [res("place-a", {"name": "A", "location_type": 1, "vehicle_type": None},
                        {"parent_station": {"data": None}}, "stop"),
                    res("70001", {"name": "B", "location_type": 0, "vehicle_type": 1},
                        {"parent_station": {"data": {"id": "place-a", "type": "stop"}}}, "stop")]}
    rows = {r["stop_id"]: r for r in load(spark, tmpdir_path, "stops", doc).collect()}
    assert rows["place-a"]["parent_station_id"] is None
    assert rows["place-a"]["location_type_desc"] == "Station" and rows["place-a"]["vehicle_type_desc"] is None
    assert rows["70001"]["location_type_desc"] == "Stop/Platform" and rows["70001"]["parent_station_id"] == "place-a"


def test_empty_document_has_schema(spark, tmpdir_path):
    df = load(spark, tmpdir_path, "trips", {"data": []})
    assert df.count() == 0 and "trip_id" in df.columns and len(df.columns) == 12


def test_schedule_first_stop_instant(spark, tmpdir_path):
    doc = {"data": [res("s1", {"arrival_time": None, "departure_time": "2026-04-19T06:00:00-04:00",
                               "stop_sequence": 1}, {"trip": {"data": {"id": "t1", "type": "trip"}}}, "schedule")]}
    df = load(spark, tmpdir_path, "schedules", doc)
    r = df.first()
    assert r["arrival_time"] is None and r["departure_time"] == "2026-04-19T06:00:00-04:00"
    assert df.select(F.col("departure_time").cast("timestamp")).first()[0] == dt.datetime(2026, 4, 19, 10, 0)


def test_vehicle_occupancy(spark, tmpdir_path):
    car = lambda p: {"label": "c", "occupancy_status": "x", "occupancy_percentage": p}
    doc = {"data": [res("v1", {"carriages": [car(9), car(7), car(9)]}, {}, "vehicle"),
                    res("v2", {"carriages": []}, {}, "vehicle"),
                    res("v3", {"carriages": [car(None)]}, {}, "vehicle")]}
    rows = {r["vehicle_id"]: r for r in load(spark, tmpdir_path, "vehicles", doc).collect()}
    assert rows["v1"]["carriage_count"] == 3 and rows["v1"]["avg_occupancy_pct"] == 8.33
    assert rows["v2"]["carriage_count"] == 0 and rows["v2"]["avg_occupancy_pct"] is None
    assert rows["v3"]["avg_occupancy_pct"] is None
    assert rows["v1"]["extracted_at"] == "2025-06-20T14:30:00+00:00"


def test_alert_window_and_entities(spark, tmpdir_path):
    ents = [{"stop": s, "route": "Red", "route_type": 1, "activities": ["BOARD"]} for s in ("s1", "s2", "s3")]
    doc = {"data": [res("a1", {"severity": 7, "active_period": [{"start": "2025-06-20T10:00:00Z", "end": None}],
                               "informed_entity": ents}, None, "alert")]}
    r = load(spark, tmpdir_path, "alerts", doc).first()
    assert r["active_start"] == "2025-06-20T10:00:00Z" and r["active_end"] is None
    assert r["informed_entity_count"] == 3 and r["affected_routes"] == ["Red"]
    assert r["affected_stops"] == ["s1", "s2", "s3"]


def test_weather_arrays(spark, tmpdir_path):
    def w(doc, name):
        p = f"{tmpdir_path}/{name}.json"
        with open(p, "w") as f:
            json.dump(doc, f)
        return D.read_weather(spark, p)
    hourly = {"time": ["2025-06-20T00:00", "2025-06-20T01:00", "2025-06-20T02:00"],
              "temperature_2m": [20.0, 19.5, 19.0], "precipitation": [0.0, 0.0, 0.1],
              "weather_code": [0, 3, 51], "visibility": [10000.0]}
    rows = w({"hourly": hourly}, "three").orderBy("timestamp").collect()
    assert len(rows) == 3 and rows[2]["precipitation"] == 0.1 and rows[2]["weather_code"] == 51
    assert rows[1]["visibility"] is None
    assert w({"hourly": {"time": []}}, "empty").count() == 0
    assert w({}, "missing").count() == 0
