"""Schedule queries (N24–N26) over raw schedules with service dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.core import service_date
from transitlake.plans.queries.common import route_color, top


def _with_service_date(s: DataFrame, tz: str) -> DataFrame:
    return s.filter(F.col("departure_time").isNotNull()).withColumn(
        "service_date", service_date(F.col("departure_time").cast("timestamp"), tz))


def _window(s: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a service-date window.

    The service date is computed, so a range on the departure instant that
    holds the window in every zone goes with it: that one reaches the scan.
    """
    if isinstance(s.schema["departure_time"].dataType, T.TimestampType):
        s = s.filter((F.col("departure_time") >= F.date_sub(F.lit(start).cast("date"), 1).cast("timestamp"))
                     & (F.col("departure_time") < F.date_add(F.lit(end).cast("date"), 3).cast("timestamp")))
    return s.filter(F.col("service_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def by_route(m, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """Per-route schedule summary over a service-date window."""
    s = _window(_with_service_date(m.raw.schedules, tz), start, end)
    r = F.broadcast(m.raw.routes.select("route_id", F.col("long_name").alias("route_name"),
                                        "route_type_desc", "route_type", "color", "sort_order"))
    g = (s.join(r, "route_id")
         .groupBy("route_id", "route_name", "route_type_desc", "route_type", "color", "sort_order")
         .agg(F.count(F.lit(1)).alias("total_stops"), F.countDistinct("trip_id").alias("total_trips"),
              F.countDistinct("stop_id").alias("unique_stops"),
              F.min("departure_time").alias("first_departure"),
              F.max("departure_time").alias("last_departure")))
    return g.select("route_id", "route_name", "route_type_desc", "route_type",
                    route_color().alias("route_color"), "sort_order", "total_stops", "total_trips",
                    "unique_stops", "first_departure", "last_departure")


def stop_departures(m, stop_id: str, start: str, end: str, tz: str = "UTC",
                    limit: int = 300) -> DataFrame:
    s = _window(_with_service_date(m.raw.schedules.filter(F.col("stop_id") == stop_id), tz), start, end)
    r = F.broadcast(m.raw.routes.select("route_id", F.col("long_name").alias("route_name"),
                                        "color", "route_type_desc"))
    d = s.join(r, "route_id").select(
        "route_id", "route_name", route_color().alias("route_color"), "route_type_desc", "trip_id",
        "departure_time", "service_date", "direction_id", "stop_headsign")
    return top(d, limit, F.col("service_date"), F.col("departure_time"), F.col("trip_id"),
               F.col("route_id"))


def timetable(m, route_id: str, direction_id: int, start: str, end: str, tz: str = "UTC",
              limit: int = 1000) -> DataFrame:
    s = m.raw.schedules.filter((F.col("route_id") == route_id)
                               & (F.col("direction_id") == int(direction_id)))
    s = _window(_with_service_date(s, tz), start, end)
    st = m.raw.stops.select("stop_id", F.col("name").alias("stop_name"))
    d = s.join(st, "stop_id").select(
        "trip_id", "stop_id", "stop_name", "stop_sequence", "direction_id", "arrival_time",
        "departure_time", "service_date", "timepoint")
    return top(d, limit, F.col("service_date"), F.col("departure_time"), F.col("stop_sequence"),
               F.col("trip_id"), F.col("stop_id"))
