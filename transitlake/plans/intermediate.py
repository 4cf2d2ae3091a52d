"""Intermediate models: scheduled-vs-predicted delay, stop activity,
alert impacts, weather exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import seconds_between, service_date
from transitlake.functions.labels import delay_category, severity_category
from transitlake.plans.staging import PREDICTION_COLS

# Delays (seconds) that the model keeps (fixed values of the source).
DELAY_RANGE = (-1800, 3600)

SVA_COLS = ["prediction_id", "route_id", "route_name", "route_type", "route_type_desc",
            "stop_id", "stop_name", "municipality", "latitude", "longitude", "trip_id",
            "vehicle_id", "direction_id", "stop_sequence", "service_date", "scheduled_arrival",
            "scheduled_departure", "timepoint", "predicted_arrival", "predicted_departure",
            "arrival_uncertainty", "departure_uncertainty", "delay_seconds",
            "schedule_relationship", "status", "revenue", "update_type", "extracted_at",
            "delay_category", "is_late", "is_significantly_late"]


def scheduled_vs_actual(stg_predictions: DataFrame, stg_schedules: DataFrame,
                        stg_routes: DataFrame, stg_stops: DataFrame,
                        tz: str = "UTC", in_range: bool = True, latest: bool = False) -> DataFrame:
    """Delay of every latest prediction against its same-service-day schedule.

    ``in_range=False`` keeps the delays that the model drops as impossible.
    Columns of predictions that the input lacks are left out of the result.
    ``latest=True`` tells that predictions hold one row per (trip_id, stop_id):
    then the date is compared after a join on these two, by which the latest
    rows lie already, so they are not shuffled again.

    The source model left-joins and then drops rows whose delay is NULL, so
    an unmatched prediction never survives: the join is written as an inner
    equi-join on (trip_id, stop_id, service_date), which lets the planner
    filter NULL keys before the shuffle. Only the columns the delay needs
    cross the shuffle; dimensions are joined after the fact-fact join.
    """
    p = (stg_predictions
         .filter(F.coalesce("predicted_arrival", "predicted_departure").isNotNull())
         .withColumn("service_date",
                     service_date(F.coalesce("predicted_arrival", "predicted_departure"), tz)))
    s = (stg_schedules
         .select("trip_id", "stop_id", "scheduled_arrival", "scheduled_departure", "timepoint",
                 service_date(F.coalesce("scheduled_arrival", "scheduled_departure"), tz)
                 .alias("service_date")))
    if latest:
        s = s.withColumnRenamed("service_date", "_scheduled_date")
        j = p.join(s, ["trip_id", "stop_id"]).filter(F.date_diff("service_date", "_scheduled_date") == 0)
    else:
        j = p.join(s, ["trip_id", "stop_id", "service_date"], "inner")
    arr = F.when(F.col("predicted_arrival").isNotNull() & F.col("scheduled_arrival").isNotNull(),
                 seconds_between("scheduled_arrival", "predicted_arrival"))
    dep = F.when(F.col("predicted_departure").isNotNull() & F.col("scheduled_departure").isNotNull(),
                 seconds_between("scheduled_departure", "predicted_departure"))
    d = F.col("delay_seconds")
    fits = d.isNotNull() & d.between(*DELAY_RANGE) if in_range else d.isNotNull()
    c = (j.withColumn("delay_seconds", F.coalesce(arr, dep))
          .filter(fits)
          .withColumn("delay_category", delay_category(d))
          .withColumn("is_late", F.coalesce(d > 60, F.lit(False)))
          .withColumn("is_significantly_late", F.coalesce(d > 300, F.lit(False))))
    routes = F.broadcast(stg_routes.select(
        "route_id", F.col("long_name").alias("route_name"), "route_type", "route_type_desc"))
    stops = stg_stops.select("stop_id", "stop_name", "municipality", "latitude", "longitude")
    return (c.join(routes, "route_id", "left")
             .join(stops, "stop_id", "left")
             .select(*[x for x in SVA_COLS if x in c.columns or x not in PREDICTION_COLS]))


def stop_activity(stg_vehicles: DataFrame, stg_stops: DataFrame,
                  stg_routes: DataFrame) -> DataFrame:
    """Hourly vehicle activity per stop / route / direction.

    Snapshots are aggregated by their keys first; names are joined to the few
    groups that are left.
    """
    st = F.col("current_status")
    v = (stg_vehicles.filter(F.col("stop_id").isNotNull())
         .groupBy("stop_id", "route_id", F.date_trunc("hour", "extracted_at").alias("activity_hour"), "direction_id")
         .agg(F.countDistinct("vehicle_id").alias("vehicle_count"),
              F.count(F.lit(1)).alias("observation_count"),
              F.avg("avg_occupancy_pct").alias("mean_occupancy_pct"),
              F.max("avg_occupancy_pct").alias("max_occupancy_pct"),
              F.min("avg_occupancy_pct").alias("min_occupancy_pct"),
              F.count_if(st == "STOPPED_AT").alias("stopped_count"),
              F.count_if(st == "IN_TRANSIT_TO").alias("in_transit_count"),
              F.count_if(st == "INCOMING_AT").alias("incoming_count")))
    stops = stg_stops.select("stop_id", "stop_name", "municipality", "location_type_desc")
    routes = F.broadcast(stg_routes.select(
        "route_id", F.col("long_name").alias("route_name"), "route_type_desc"))
    return (v.join(stops, "stop_id", "left").join(routes, "route_id", "left")
            .select("stop_id", "stop_name", "municipality", "location_type_desc", "route_id", "route_name",
                    "route_type_desc", "activity_hour", "direction_id", *v.columns[4:]))


def alert_impacts(stg_alerts: DataFrame) -> DataFrame:
    """Duration, severity class and the mart's notion of 'active'."""
    both = F.col("active_end").isNotNull() & F.col("active_start").isNotNull()
    secs = seconds_between("active_start", "active_end")
    return stg_alerts.select(
        "alert_id", "cause", "effect", "severity", "lifecycle", "header", "service_effect",
        "duration_certainty", "active_start", "active_end", "created_at", "updated_at",
        "closed_timestamp", "affected_routes", "affected_stops", "informed_entity_count",
        "extracted_at",
        F.when(both, secs).alias("duration_seconds"),
        F.when(both, secs / 3600.0).alias("duration_hours"),
        severity_category("severity", "mart").alias("severity_category"),
        F.when(F.col("lifecycle") == "ONGOING", F.lit(True))
         .when(F.col("active_end").isNull() & F.col("closed_timestamp").isNull(), F.lit(True))
         .otherwise(F.lit(False)).alias("is_active"))


def weather_transit(sva: DataFrame, stg_weather: DataFrame) -> DataFrame:
    """Each delay observation with the weather of its hour (left join).

    The weather side is one row per hour, so it is bounded by the time span,
    not by traffic; AQE turns the join into a broadcast from runtime size.
    """
    d = sva.select(
        "prediction_id", "route_id", "stop_id", "trip_id", "predicted_arrival",
        "predicted_departure", "scheduled_arrival", "scheduled_departure", "delay_seconds",
        "extracted_at",
        F.date_trunc("hour", F.coalesce("predicted_arrival", "predicted_departure"))
         .alias("prediction_hour"))
    w = stg_weather.select(
        F.col("weather_timestamp").alias("prediction_hour"), "temperature_f", "humidity_pct",
        "precipitation_mm", "rain_mm", "snowfall_cm", "wind_speed_mph", "wind_gusts_mph",
        "visibility_m", "weather_code", "weather_condition")
    j = d.join(w, "prediction_hour", "left")
    flag = lambda cond: F.coalesce(cond, F.lit(False))
    return j.select(
        "prediction_id", "route_id", "stop_id", "trip_id", "predicted_arrival",
        "predicted_departure", "prediction_hour", "scheduled_arrival", "scheduled_departure",
        "delay_seconds", "temperature_f", "humidity_pct", "precipitation_mm", "rain_mm",
        "snowfall_cm", "wind_speed_mph", "wind_gusts_mph", "visibility_m", "weather_code",
        "weather_condition",
        flag(F.col("precipitation_mm") > 0).alias("is_precipitation"),
        flag(F.col("snowfall_cm") > 0).alias("is_snow"),
        flag(F.col("visibility_m") < 5000).alias("is_low_visibility"),
        flag(F.col("wind_speed_mph") > 25).alias("is_high_wind"),
        "extracted_at")
