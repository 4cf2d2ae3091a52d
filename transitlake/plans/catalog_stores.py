"""Jobs that write the derived tables through the load rules and read them back:
landing, loads, copies, seeds, exports, and the SQL helper functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.sql import register_sql_functions
from transitlake.operators import loads, quality, trees
from transitlake.plans import features as FE
from transitlake.plans import staging
from transitlake.plans.catalog_ml import _FM
from transitlake.plans.catalog_ops import _suite_sql
from transitlake.plans.catalog_sources import docs_roundtrip
from transitlake.plans.oracle_sql import rnd, sdate
from transitlake.plans.queries import routes as qr
from transitlake.plans.queries import stations as qst
from transitlake.plans.registry import final_sql, register, register_raw
from transitlake.session import checkpoint_dir
from transitlake.sources import landed
from transitlake.sources.schemas import REGISTRY, STOPS

DAY_1, DAY_2 = "2024-01-30T06:00:00+00:00", "2024-01-31T06:00:00+00:00"
HOUR_1, HOUR_2 = "2024-01-31T07:10:00+00:00", "2024-01-31T08:10:00+00:00"


def _folder(m, name: str) -> str:
    return f"{checkpoint_dir(m.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


def _store(m, name: str) -> loads.RawStore:
    # The synthetic snapshots spread over seven years: months, not days.
    return loads.RawStore(m.spark, _folder(m, name), unit="month")


# -- documents (B3-B5) ----------------------------------------------------------
register_raw("b3_trip_documents", "SELECT * REPLACE (NULLIF(name, '') AS name) FROM raw_trips")(
    lambda spark, d: docs_roundtrip(spark, d, "trips"))
register_raw("b4_schedule_documents_to_staging", "SELECT * FROM stg_schedules")(
    lambda spark, d: staging.stg_schedules(docs_roundtrip(spark, d, "schedules")))
register_raw("b5_prediction_documents_to_staging", "SELECT * FROM stg_predictions")(
    lambda spark, d: staging.stg_predictions(docs_roundtrip(spark, d, "predictions")))


# -- landing and scans (C1, C2, A1, A2, B9) -----------------------------------------
def landed_days(m):
    """A dimension landed daily: the second day's first, partial batch is replaced by its second one."""
    store, root, stops = _store(m, "c1"), _folder(m, "c1-landing"), m.raw.stops
    store.land("stops", stops, root, DAY_1)
    store.land("stops", stops.filter(F.col("location_type") == 0), root, DAY_2)
    path = store.land("stops", stops, root, DAY_2)
    return store.read_source(path, schema=T.StructType(STOPS.fields).add("extracted_at", T.StringType()))


register("c1_daily_landing", f"""
SELECT *, '{DAY_1}' AS extracted_at FROM raw_stops UNION ALL SELECT *, '{DAY_2}' FROM raw_stops""")(landed_days)


def _landed_hours(m, name: str):
    """Snapshots landed as two hourly batches, each under one stamp."""
    store, root, v = _store(m, name), _folder(m, f"{name}-landing"), m.raw.vehicles
    first = F.coalesce("direction_id", F.lit(0)) == 0
    store.land("vehicles", v.filter(first), root, HOUR_1)
    return store, store.land("vehicles", v.filter(~first), root, HOUR_2), v.drop("extracted_at").schema.add(
        "extracted_at", T.StringType())


def landed_hours(m):
    store, path, schema = _landed_hours(m, "c2")
    return store.read_source(path, schema=schema)


def one_hour(m):
    """The files of one hour alone, by a glob."""
    store, path, schema = _landed_hours(m, "a2")
    return store.read_source(f"{path}/dt=*/hr=07", schema=schema)


register("c2_hourly_landing", f"""
SELECT * REPLACE (CASE WHEN coalesce(direction_id, 0) = 0 THEN '{HOUR_1}' ELSE '{HOUR_2}' END AS extracted_at)
FROM raw_vehicles""")(landed_hours)
register("a2_landed_hour", f"""
SELECT * REPLACE ('{HOUR_1}' AS extracted_at) FROM raw_vehicles WHERE coalesce(direction_id, 0) = 0""")(one_hour)


# -- unions and loads (A3, L2, C3, C6, C9, C10, C11, C12) ----------------------------
def relaxed_union(m):
    """Snapshots of two feeds side by side: columns by name, types widened, what a feed lacks NULL."""
    p = m.raw.predictions.select("stop_id", "trip_id", F.col("direction_id").cast("long"), "status")
    v = m.raw.vehicles.select("stop_id", "trip_id", "direction_id", "speed")
    return loads.union_relaxed([p, v])


register("a3_relaxed_union", """
SELECT stop_id, trip_id, CAST(direction_id AS BIGINT) AS direction_id, status, NULL::DOUBLE AS speed FROM raw_predictions
UNION ALL SELECT stop_id, trip_id, direction_id, NULL, speed FROM raw_vehicles""")(relaxed_union)


def refreshed(m):
    """A replaced table holds the second load alone."""
    store, stops = _store(m, "c3"), m.raw.stops
    store.load("stops", stops.filter(F.col("location_type") == 0), count=False)
    store.load("stops", stops, count=False)
    return store.rows("stops")


register("c3_full_refresh", "SELECT * FROM raw_stops")(refreshed)


def fewer_columns(m):
    """A later batch without ``label`` and with a column that the table lacks."""
    store, v = _store(m, "c6"), m.raw.vehicles
    store.load("vehicles", v, count=False)
    later = v.withColumn("extracted_at", F.col("extracted_at") + F.expr("INTERVAL 10 YEARS"))
    store.load("vehicles", later.drop("label").withColumn("firmware", F.lit("7")), count=False)
    return store.rows("vehicles").groupBy("vehicle_id", "label").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max("extracted_at").alias("last_seen"))


register("c6_column_intersection", """
WITH later AS (SELECT * REPLACE (extracted_at + INTERVAL 10 YEAR AS extracted_at, NULL::VARCHAR AS label) FROM raw_vehicles)
SELECT vehicle_id, label, count(DISTINCT extracted_at) AS snapshots, max(extracted_at) AS last_seen
FROM (SELECT * FROM raw_vehicles UNION ALL SELECT * FROM later) v GROUP BY vehicle_id, label""")(fewer_columns)


def loaded_all(m):
    """Every entity from its landing folder; the broken files of one leave the others alone."""
    store, root = _store(m, "c9"), _folder(m, "c9-landing")
    m.raw.routes.write.parquet(f"{root}/routes")
    m.raw.stops.write.parquet(f"{root}/stops")
    m.raw.trips.select("trip_id").write.text(f"{root}/trips")
    return store.load_all(root)


register("c9_load_all", "\nUNION ALL ".join(
    f"SELECT '{e}' AS entity, " + (f"count(*) AS row_count FROM raw_{e}" if e in ("routes", "stops")
                                   else f"CAST({-1 if e == 'trips' else 0} AS BIGINT)") for e in REGISTRY))(loaded_all)


def _loaded(m, name: str):
    store = _store(m, name)
    for e in ("routes", "stops", "vehicles"):
        store.load(e, getattr(m.raw, e), count=False)
    return store


_SNAPSHOTS = "(SELECT DISTINCT vehicle_id, extracted_at FROM raw_vehicles) v"
register("c10b_store_stats", f"""
SELECT 'raw_routes' AS table_name, count(*) AS row_count FROM raw_routes
UNION ALL SELECT 'raw_stops', count(*) FROM raw_stops UNION ALL SELECT 'raw_vehicles', count(*) FROM {_SNAPSHOTS}""")(
    lambda m: _loaded(m, "c10").stats())
register("c11_store_sql", f"""
SELECT s.municipality, count(*) AS snapshots FROM (
  SELECT vehicle_id, extracted_at, max(stop_id) AS stop_id FROM raw_vehicles GROUP BY ALL) v
JOIN raw_stops s USING (stop_id) GROUP BY s.municipality""")(
    lambda m: _loaded(m, "c11").sql("""
SELECT s.municipality, count(*) AS snapshots FROM (
  SELECT vehicle_id, extracted_at, max(stop_id) AS stop_id FROM raw_vehicles GROUP BY vehicle_id, extracted_at) v
JOIN raw_stops s USING (stop_id) GROUP BY s.municipality"""))
# The stored table through the checker.
register("a9_stored_table_suite", _suite_sql("stops"))(
    lambda m: quality.validate_all({"stops": _loaded(m, "a9").rows("stops")}))


def copied_tree(m):
    """A partitioned table mirrored file by file; a second run finds nothing to copy."""
    src, dst = _folder(m, "c12-from"), _folder(m, "c12-to")
    m.raw.trips.write.partitionBy("direction_id").parquet(src)
    trees.copy_tree(m.spark, src, dst)
    again = trees.copy_tree(m.spark, src, dst)
    return m.spark.read.parquet(dst).select(*m.raw.trips.columns).withColumn("copied_again", F.lit(again))


register("c12_copied_tree", "SELECT *, 0 AS copied_again FROM raw_trips")(copied_tree)


# -- seed, lookups, saved matrix (A8, A10, A11, C14) -----------------------------------
def seed_scan(m):
    """The mode seed of the feed's modes as a CSV file, joined back to the routes."""
    path = _folder(m, "a8-seed")
    landed.route_type_seed(m.spark).join(m.raw.routes, "route_type", "left_semi").write.option("header", True).csv(path)
    return (m.raw.routes.join(landed.read_seed(m.spark, path), "route_type")
            .groupBy("route_type", "route_type_name", "route_type_category").agg(F.count(F.lit(1)).alias("routes")))


register("a8_seed_scan", """
SELECT route_type, route_type_desc AS route_type_name,
  CASE WHEN route_type IN (0, 1, 2) THEN 'Rail' WHEN route_type = 3 THEN 'Bus' ELSE 'Ferry' END AS route_type_category,
  count(*) AS routes FROM raw_routes GROUP BY ALL""")(seed_scan)
register("a10_bus_route_ids", "SELECT route_id FROM raw_routes WHERE route_type = 3")(
    lambda m: landed.mode_route_ids(m.raw.routes))
register("a11_saved_feature_matrix", f"WITH {_FM} SELECT * FROM fm")(
    lambda m: FE.read_feature_matrix(m.spark, FE.write_feature_matrix(FE.feature_matrix(m), _folder(m, "c14"))))


# -- exports (C15, C16) ------------------------------------------------------------------
_REPORT = ("route_id", "route_name", "mode", "on_time_pct", "avg_delay_minutes", "trips")


def route_report_csv(m):
    """The route report written as CSV and read back as text."""
    path = loads.report_csv(loads.route_report(qr.reliability_list(m)), _folder(m, "c15"), loads.ROUTE_REPORT)
    return m.spark.read.option("header", True).csv(path).toDF(*_REPORT)


def _tenths(x: str) -> str:
    return f"CAST(CAST({rnd(f'coalesce({x}, 0)', 1)} AS DECIMAL(18, 1)) AS VARCHAR)"


register("c15_route_report", f"""
WITH r AS ({final_sql('n22_routes_reliability')})
SELECT route_id, coalesce(nullif(route_name, ''), route_id) AS route_name, coalesce(route_type_desc, '') AS mode,
  {_tenths('on_time_pct')} AS on_time_pct, {_tenths('avg_delay_minutes')} AS avg_delay_minutes,
  CAST(coalesce(total_predictions, 0) AS VARCHAR) AS trips FROM r""")(route_report_csv)

_POINT = ("type string, geometry struct<type string, coordinates array<double>>, "
          "properties struct<stop_id string, stop_name string, municipality string, routes_served long>")
_LINE = ("type string, geometry struct<type string, coordinates array<array<double>>>, "
         "properties struct<route_id string, route_type int, route_type_desc string, color string>")


def station_points(m):
    """The point features of the located stations, parsed again."""
    f = F.from_json("feature", _POINT)
    rows = loads.stations_geojson(qst.map_stations(m)).select("stop_id", f.alias("f"))
    return rows.select("stop_id", F.col("f.type").alias("feature_type"), F.col("f.geometry.type").alias("geometry_type"),
                       F.col("f.geometry.coordinates")[0].alias("lng"), F.col("f.geometry.coordinates")[1].alias("lat"),
                       F.col("f.properties.stop_name").alias("stop_name"),
                       F.col("f.properties.routes_served").alias("routes_served"))


register("c16b_station_points", f"""
WITH s AS ({final_sql('n09_map_stations')})
SELECT stop_id, 'Feature' AS feature_type, 'Point' AS geometry_type, {rnd('longitude', 5)} AS lng,
  {rnd('latitude', 5)} AS lat, stop_name, routes_served FROM s""")(station_points)


def line_points(m):
    """The line features of the routes, parsed again: one row per point."""
    f = F.from_json("feature", _LINE)
    rows = loads.route_lines_geojson(qst.route_lines(m)).select("route_id", f.alias("f"))
    return rows.select("route_id", F.col("f.properties.color").alias("color"),
                       F.posexplode("f.geometry.coordinates").alias("pos", "xy")).select(
        "route_id", "color", "pos", F.col("xy")[0].alias("lng"), F.col("xy")[1].alias("lat"))


register("c16c_route_line_points", f"""
WITH l AS ({final_sql('n08_map_route_lines')}),
n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS points,
  CAST(row_number() OVER (PARTITION BY route_id ORDER BY stop_sequence, stop_id) - 1 AS INTEGER) AS pos FROM l)
SELECT route_id, '#' || route_color AS color, pos, {rnd('longitude', 5)} AS lng, {rnd('latitude', 5)} AS lat
FROM n WHERE points >= 2""")(line_points)


# -- SQL helper functions (S1, S2) ------------------------------------------------------------
def service_days_by_sql(m):
    """Departures per service day, by the SQL functions."""
    register_sql_functions(m.spark)
    s = m.stg_schedules.filter("scheduled_departure IS NOT NULL")
    days = s.select(F.expr("tl_service_date(scheduled_departure)").alias("service_date"),
                    F.expr("tl_service_seconds(scheduled_departure)").alias("second"),
                    F.expr("tl_seconds_between(scheduled_arrival, scheduled_departure)").alias("dwell"))
    return days.groupBy("service_date", F.expr("tl_day_of_week(service_date)").alias("day_of_week"),
                        F.expr("tl_is_weekend(service_date)").alias("is_weekend")).agg(
        F.count(F.lit(1)).alias("departures"), F.min("second").alias("first_second"),
        F.max("second").alias("last_second"), F.sum("dwell").alias("dwell_seconds"))


_H = "hour(scheduled_departure)"
register("s1_sql_functions", f"""
WITH d AS (SELECT {sdate('scheduled_departure')} AS service_date,
  (CASE WHEN {_H} < 3 THEN {_H} + 24 ELSE {_H} END) * 3600 + minute(scheduled_departure) * 60
    + second(scheduled_departure) AS second,
  CAST(date_diff('second', scheduled_arrival, scheduled_departure) AS BIGINT) AS dwell
  FROM stg_schedules WHERE scheduled_departure IS NOT NULL)
SELECT service_date, CAST(dayofweek(service_date) + 1 AS INTEGER) AS day_of_week,
  dayofweek(service_date) IN (0, 6) AS is_weekend, count(*) AS departures, min(second) AS first_second,
  max(second) AS last_second, CAST(sum(dwell) AS BIGINT) AS dwell_seconds FROM d GROUP BY ALL""")(service_days_by_sql)
