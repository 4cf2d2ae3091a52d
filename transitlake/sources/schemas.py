"""Declared raw entity schemas and the entity registry (one dict).

Raw times arrive as ISO-8601 text; staging casts them to instants. The
registry records table name, load mode, key columns and partition layout
per entity; unknown entities are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
SA = T.ArrayType(T.StringType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ROUTES = _schema(("route_id", S), ("long_name", S), ("short_name", S), ("description", S),
                 ("fare_class", S), ("route_type", I), ("route_type_desc", S), ("color", S),
                 ("text_color", S), ("sort_order", I), ("direction_names", SA),
                 ("direction_destinations", SA), ("listed_route", B), ("line_id", S),
                 ("agency_id", S))
STOPS = _schema(("stop_id", S), ("name", S), ("description", S), ("latitude", D),
                ("longitude", D), ("address", S), ("municipality", S), ("on_street", S),
                ("at_street", S), ("location_type", I), ("location_type_desc", S),
                ("vehicle_type", I), ("vehicle_type_desc", S), ("platform_code", S),
                ("platform_name", S), ("wheelchair_boarding", I), ("parent_station_id", S),
                ("zone_id", S))
TRIPS = _schema(("trip_id", S), ("headsign", S), ("name", S), ("direction_id", I),
                ("block_id", S), ("bikes_allowed", I), ("wheelchair_accessible", I),
                ("revenue", S), ("route_id", S), ("route_pattern_id", S), ("service_id", S),
                ("shape_id", S))
SCHEDULES = _schema(("schedule_id", S), ("arrival_time", S), ("departure_time", S),
                    ("direction_id", I), ("stop_sequence", I), ("stop_headsign", S),
                    ("pickup_type", I), ("drop_off_type", I), ("timepoint", B),
                    ("route_id", S), ("stop_id", S), ("trip_id", S))
PREDICTIONS = _schema(("prediction_id", S), ("arrival_time", S), ("arrival_uncertainty", I),
                      ("departure_time", S), ("departure_uncertainty", I), ("direction_id", I),
                      ("stop_sequence", I), ("schedule_relationship", S), ("status", S),
                      ("revenue", S), ("last_trip", B), ("update_type", S), ("route_id", S),
                      ("stop_id", S), ("trip_id", S), ("vehicle_id", S), ("extracted_at", S))
VEHICLES = _schema(("vehicle_id", S), ("label", S), ("latitude", D), ("longitude", D),
                   ("bearing", I), ("speed", D), ("current_status", S),
                   ("current_stop_sequence", I), ("direction_id", I), ("occupancy_status", S),
                   ("carriage_count", I), ("avg_occupancy_pct", D), ("revenue", S),
                   ("updated_at", S), ("route_id", S), ("stop_id", S), ("trip_id", S),
                   ("extracted_at", S))
ALERTS = _schema(("alert_id", S), ("cause", S), ("effect", S), ("severity", I),
                 ("lifecycle", S), ("header", S), ("description", S), ("short_header", S),
                 ("service_effect", S), ("duration_certainty", S), ("active_start", S),
                 ("active_end", S), ("created_at", S), ("updated_at", S),
                 ("closed_timestamp", S), ("url", S), ("affected_routes", SA),
                 ("affected_stops", SA), ("informed_entity_count", I), ("extracted_at", S))
WEATHER = _schema(("timestamp", S), ("temperature_2m", D), ("relative_humidity_2m", D),
                  ("precipitation", D), ("rain", D), ("snowfall", D), ("wind_speed_10m", D),
                  ("wind_gusts_10m", D), ("visibility", D), ("weather_code", I))
ROUTE_TYPE_MAPPING = _schema(("route_type", I), ("route_type_name", S),
                             ("route_type_category", S))

# Columns holding ISO instants in each raw entity (cast by staging).
TIME_COLUMNS = {
    "schedules": ("arrival_time", "departure_time"),
    "predictions": ("arrival_time", "departure_time", "extracted_at"),
    "vehicles": ("updated_at", "extracted_at"),
    "alerts": ("active_start", "active_end", "created_at", "updated_at", "closed_timestamp",
               "extracted_at"),
}


@dataclass(frozen=True)
class Entity:
    name: str
    schema: T.StructType
    keys: tuple
    mode: str            # "replace" | "append"
    kind: str            # "dimension" (daily dt=) | "fact" (dt=/hr=)
    min_rows: int = 1

    @property
    def table(self) -> str:
        return f"raw_{self.name}"

    @property
    def partition_cols(self) -> tuple:
        return ("dt",) if self.kind == "dimension" else ("dt", "hr")


REGISTRY = {
    "routes": Entity("routes", ROUTES, ("route_id",), "replace", "dimension", 1),
    "stops": Entity("stops", STOPS, ("stop_id",), "replace", "dimension", 1),
    "trips": Entity("trips", TRIPS, ("trip_id",), "replace", "dimension", 1),
    "schedules": Entity("schedules", SCHEDULES,
                        ("schedule_id", "trip_id", "stop_id", "departure_time"),
                        "replace", "fact", 1),
    "predictions": Entity("predictions", PREDICTIONS, ("prediction_id", "extracted_at"),
                          "append", "fact", 1),
    "vehicles": Entity("vehicles", VEHICLES, ("vehicle_id", "extracted_at"),
                       "append", "fact", 1),
    "alerts": Entity("alerts", ALERTS, ("alert_id", "extracted_at"), "append", "fact", 0),
    "weather": Entity("weather", WEATHER, ("timestamp",), "replace", "dimension", 1),
}

# Key columns used to de-duplicate append-mode (snapshot) tables.
DEDUPE_KEYS = {name: e.keys for name, e in REGISTRY.items() if e.mode == "append"}


def entity(name: str) -> Entity:
    """Registry lookup; unknown names raise ``ValueError('Unknown entity …')``."""
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"Unknown entity: {name!r}. Known: {sorted(REGISTRY)}") from None
