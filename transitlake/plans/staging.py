"""Staging models: filter invalid keys, type times, de-duplicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import nullif_empty, round_half_away, to_ts
from transitlake.functions.labels import weather_condition
from transitlake.operators.latest import latest_per_key


def stg_routes(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("route_id").isNotNull()).select(
        "route_id", "long_name", nullif_empty("short_name").alias("short_name"),
        "description", "fare_class", "route_type", "route_type_desc", "color", "text_color",
        "sort_order", "listed_route", "line_id", "agency_id")


def stg_stops(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("stop_id").isNotNull() & F.col("latitude").isNotNull()
                      & F.col("longitude").isNotNull()).select(
        "stop_id", F.col("name").alias("stop_name"), "description", "latitude", "longitude",
        "address", "municipality", "on_street", "at_street", "location_type",
        "location_type_desc", "vehicle_type", "vehicle_type_desc", "platform_code",
        "platform_name", "wheelchair_boarding", "parent_station_id", "zone_id")


def stg_trips(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("trip_id").isNotNull() & F.col("route_id").isNotNull()).select(
        "trip_id", "headsign", nullif_empty("name").alias("trip_name"), "direction_id",
        "block_id", "bikes_allowed", "wheelchair_accessible", "revenue", "route_id",
        "route_pattern_id", "service_id", "shape_id")


def stg_schedules(raw: DataFrame) -> DataFrame:
    """Typed schedules. Not de-duplicated (as in the source model)."""
    return raw.filter(F.col("schedule_id").isNotNull()).select(
        "schedule_id", to_ts("arrival_time").alias("scheduled_arrival"),
        to_ts("departure_time").alias("scheduled_departure"), "direction_id", "stop_sequence",
        "stop_headsign", "pickup_type", "drop_off_type", "timepoint", "route_id", "stop_id",
        "trip_id")


PREDICTION_COLS = ["prediction_id", "predicted_arrival", "arrival_uncertainty",
                   "predicted_departure", "departure_uncertainty", "direction_id",
                   "stop_sequence", "schedule_relationship", "status", "revenue", "last_trip",
                   "update_type", "route_id", "stop_id", "trip_id", "vehicle_id", "extracted_at"]


PREDICTION_ORDER = ["extracted_at", "prediction_id", "predicted_arrival", "predicted_departure"]


def typed_predictions(raw: DataFrame) -> DataFrame:
    """Typed prediction snapshots (no de-duplication); batch or stream."""
    return raw.filter(F.col("prediction_id").isNotNull()).select(
        "prediction_id", to_ts("arrival_time").alias("predicted_arrival"),
        "arrival_uncertainty", to_ts("departure_time").alias("predicted_departure"),
        "departure_uncertainty", "direction_id", "stop_sequence", "schedule_relationship",
        F.col("status").cast("string").alias("status"), "revenue", "last_trip", "update_type",
        "route_id", "stop_id", "trip_id", "vehicle_id", to_ts("extracted_at").alias("extracted_at"))


def stg_predictions(raw: DataFrame, columns: Sequence[str] = PREDICTION_COLS) -> DataFrame:
    """Latest prediction per (trip_id, stop_id) by ``extracted_at``.

    ``columns`` cuts the rows before the aggregate, through which columns
    cannot be pruned; keys and ordering columns always come along.

    Ties on ``extracted_at`` are broken by prediction id, then predicted
    arrival and departure (descending), so the survivor is deterministic.
    """
    return latest_per_key(_narrow(typed_predictions(raw), columns, ["trip_id", "stop_id", *PREDICTION_ORDER]),
                          ["trip_id", "stop_id"], PREDICTION_ORDER).select(*columns)


def _narrow(df: DataFrame, columns: Sequence[str], needed: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in columns or c in needed])


VEHICLE_COLS = ["vehicle_id", "label", "latitude", "longitude", "bearing", "speed",
                "current_status", "current_stop_sequence", "direction_id", "occupancy_status",
                "carriage_count", "avg_occupancy_pct", "revenue", "vehicle_updated_at",
                "route_id", "stop_id", "trip_id", "extracted_at"]


def stg_vehicles_stream(raw: DataFrame) -> DataFrame:
    """Typed vehicle snapshots without the de-dup (for streams, where the
    exactly-once raw append already guarantees one row per key)."""
    return raw.filter(F.col("vehicle_id").isNotNull()).select(
        "vehicle_id", "label", "latitude", "longitude", "bearing", "speed", "current_status",
        "current_stop_sequence", "direction_id", "occupancy_status", "carriage_count",
        "avg_occupancy_pct", "revenue", to_ts("updated_at").alias("vehicle_updated_at"),
        "route_id", "stop_id", "trip_id", to_ts("extracted_at").alias("extracted_at"))


VEHICLE_ORDER = ["vehicle_updated_at", "trip_id", "stop_id", "route_id", "latitude", "longitude"]


def stg_vehicles(raw: DataFrame, columns: Sequence[str] = VEHICLE_COLS) -> DataFrame:
    """One row per (vehicle_id, extracted_at); ``columns`` as in ``stg_predictions``."""
    keys = ["vehicle_id", "extracted_at"]
    typed = _narrow(stg_vehicles_stream(raw), columns, [*keys, *VEHICLE_ORDER])
    return latest_per_key(typed, keys, VEHICLE_ORDER).select(*columns)


ALERT_COLS = ["alert_id", "cause", "effect", "severity", "lifecycle", "header", "description",
              "short_header", "service_effect", "duration_certainty", "active_start",
              "active_end", "created_at", "updated_at", "closed_timestamp", "url",
              "affected_routes", "affected_stops", "informed_entity_count", "extracted_at"]


ALERT_ORDER = ["updated_at", "extracted_at", "header"]


def stg_alerts(raw: DataFrame, columns: Sequence[str] = ALERT_COLS) -> DataFrame:
    """Latest version per alert by coalesce(updated_at, extracted_at), then extracted_at.

    ``columns`` as in ``stg_predictions``.
    """
    typed = raw.filter(F.col("alert_id").isNotNull()).select(
        "alert_id", "cause", "effect", "severity", "lifecycle", "header", "description",
        nullif_empty("short_header").alias("short_header"), "service_effect",
        "duration_certainty", to_ts("active_start").alias("active_start"),
        to_ts("active_end").alias("active_end"), to_ts("created_at").alias("created_at"),
        to_ts("updated_at").alias("updated_at"),
        to_ts("closed_timestamp").alias("closed_timestamp"), "url", "affected_routes",
        "affected_stops", "informed_entity_count", to_ts("extracted_at").alias("extracted_at"))
    return latest_per_key(_narrow(typed, columns, ["alert_id", *ALERT_ORDER]), ["alert_id"],
                          [F.coalesce("updated_at", "extracted_at"), "extracted_at",
                           "header"]).select(*columns)


def stg_weather(raw: DataFrame) -> DataFrame:
    """Imperial unit conversions and a weather-condition class per hour."""
    t = F.col("temperature_2m")
    return raw.filter(F.col("timestamp").isNotNull()).select(
        to_ts("timestamp").alias("weather_timestamp"),
        t.alias("temperature_c"),
        round_half_away(t * 9.0 / 5.0 + 32.0, 1).alias("temperature_f"),
        F.col("relative_humidity_2m").alias("humidity_pct"),
        F.col("precipitation").alias("precipitation_mm"),
        round_half_away(F.col("precipitation") / 25.4, 3).alias("precipitation_in"),
        F.col("rain").alias("rain_mm"),
        round_half_away(F.col("rain") / 25.4, 3).alias("rain_in"),
        F.col("snowfall").alias("snowfall_cm"),
        round_half_away(F.col("snowfall") / 2.54, 3).alias("snowfall_in"),
        F.col("wind_speed_10m").alias("wind_speed_kmh"),
        round_half_away(F.col("wind_speed_10m") * 0.621371, 1).alias("wind_speed_mph"),
        F.col("wind_gusts_10m").alias("wind_gusts_kmh"),
        round_half_away(F.col("wind_gusts_10m") * 0.621371, 1).alias("wind_gusts_mph"),
        F.col("visibility").alias("visibility_m"),
        "weather_code",
        weather_condition("weather_code").alias("weather_condition"),
    )
