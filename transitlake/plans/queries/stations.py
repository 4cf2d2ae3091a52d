"""Station queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away as rha
from transitlake.plans.queries.common import minutes, route_color, top

SORTABLE = ("delay_hotspot_score", "avg_delay_seconds", "late_pct", "total_predictions",
            "routes_served", "significant_delay_pct", "p90_delay_seconds")


def _sort_col(sort_by: str) -> str:
    if sort_by not in SORTABLE:
        raise ValueError(f"sort_by must be one of {SORTABLE}, got {sort_by!r}")
    return sort_by


def delay_hotspots(m, limit: int = 10) -> DataFrame:
    sp = m.stop_performance.filter(F.col("avg_delay_seconds").isNotNull())
    sp = top(sp, limit, F.col("delay_hotspot_score").desc_nulls_last(), F.col("stop_id").asc())
    return sp.select("stop_id", "stop_name", "municipality", "latitude", "longitude",
                     "avg_delay_seconds", minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                     "late_pct", "routes_served", "delay_hotspot_score")


def route_lines(m) -> DataFrame:
    """Ordered stops of rail/ferry routes (direction 0), one row per route stop."""
    s = m.raw.schedules.filter(F.col("direction_id") == 0).select("route_id", "stop_id", "stop_sequence")
    st = m.raw.stops.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "stop_id", F.col("name").alias("stop_name"), "latitude", "longitude")
    r = F.broadcast(m.raw.routes.filter(F.col("route_type").isin(0, 1, 2, 4))
                    .select("route_id", "route_type", "route_type_desc", "color"))
    g = (s.join(r, "route_id").join(st, "stop_id")
         .groupBy("route_id", "route_type", "route_type_desc", "color", "stop_id", "stop_name",
                  "latitude", "longitude")
         .agg(F.min("stop_sequence").alias("stop_sequence")))
    return g.select("route_id", "route_type", "route_type_desc", route_color().alias("route_color"),
                    "stop_id", "stop_name", "latitude", "longitude", "stop_sequence")


def map_stations(m) -> DataFrame:
    """Located stops with ≥5 observations and their active-alert counts."""
    aa = (m.alert_summary.filter(F.col("is_active"))
          .select("alert_id", F.explode("affected_stops").alias("stop_id"))
          .groupBy("stop_id").agg(F.countDistinct("alert_id").alias("alert_count")))
    sp = m.stop_performance.filter((F.col("total_predictions") >= 5)
                                   & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return sp.join(aa, "stop_id", "left").select(
        "stop_id", "stop_name", "municipality", "latitude", "longitude",
        rha("avg_delay_seconds", 1).alias("avg_delay_seconds"),
        minutes("avg_delay_seconds").alias("avg_delay_minutes"),
        rha("late_pct", 1).alias("late_pct"), "routes_served",
        rha("delay_hotspot_score", 1).alias("delay_hotspot_score"),
        F.coalesce("alert_count", F.lit(0)).alias("active_alert_count"))


def _detail_cols():
    return ["stop_id", "stop_name", "municipality", "latitude", "longitude", "total_predictions",
            "routes_served", minutes("avg_delay_seconds").alias("avg_delay_minutes"),
            minutes("median_delay_seconds").alias("median_delay_minutes"),
            rha("late_pct", 1).alias("late_pct"),
            rha("significant_delay_pct", 1).alias("significant_delay_pct"),
            minutes("p90_delay_seconds").alias("p90_delay_minutes")]


def detail(m, stop_id: str) -> DataFrame:
    sp = m.stop_performance.filter(F.col("stop_id") == stop_id)
    return sp.select(*_detail_cols(), "total_vehicle_visits",
                     rha("avg_occupancy_pct", 1).alias("avg_occupancy_pct"),
                     rha("peak_occupancy_pct", 1).alias("peak_occupancy_pct"),
                     rha("delay_hotspot_score", 2).alias("delay_hotspot_score"))


def detail_enhanced(m, stop_id: str) -> DataFrame:
    """Station row with its routes and active alerts as nested arrays."""
    sp = m.stop_performance.filter(F.col("stop_id") == stop_id)
    routes = F.broadcast(m.raw.routes.select(
        "route_id", F.col("long_name").alias("route_name"), "route_type_desc",
        route_color().alias("route_color")))
    sr = (m.raw.schedules.filter(F.col("stop_id") == stop_id).select("route_id").distinct()
          .join(routes, "route_id"))
    sr_arr = sr.agg(F.array_sort(F.collect_list(F.struct(
        "route_id", "route_name", "route_type_desc", "route_color")))).scalar()
    al = m.alert_summary.filter(F.col("is_active") & F.array_contains("affected_stops", stop_id))
    al_arr = al.agg(F.array_sort(F.collect_list(F.struct(
        "alert_id", "header", "severity_category", "effect", "impact_score")))).scalar()
    return sp.select(
        "stop_id", "stop_name", "municipality", "latitude", "longitude", "total_predictions",
        "routes_served", "avg_delay_seconds", minutes("avg_delay_seconds").alias("avg_delay_minutes"),
        rha(F.lit(100.0) - F.col("late_pct"), 1).alias("on_time_pct"), "late_pct",
        "significant_delay_pct", "p90_delay_seconds",
        minutes("p90_delay_seconds").alias("p90_delay_minutes"), "delay_hotspot_score",
        "total_vehicle_visits", "avg_occupancy_pct", "peak_occupancy_pct",
        sr_arr.alias("routes"), al_arr.alias("active_alerts"))


def stations_map(m) -> DataFrame:
    sp = m.stop_performance.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return sp.select("stop_id", "stop_name", "municipality", "latitude", "longitude",
                     minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                     rha("late_pct", 1).alias("late_pct"),
                     rha("delay_hotspot_score", 2).alias("delay_hotspot_score"),
                     "routes_served", "total_predictions")


def performance(m, sort_by: str = "delay_hotspot_score", limit: int = 20) -> DataFrame:
    sp = top(m.stop_performance, limit, F.col(_sort_col(sort_by)).desc_nulls_last(),
             F.col("stop_id").asc())
    return sp.select(*_detail_cols(), rha("delay_hotspot_score", 2).alias("delay_hotspot_score"))


def performance_filtered(m, sort_by: str = "delay_hotspot_score", limit: int = 20) -> DataFrame:
    sp = m.stop_performance.filter((F.col("total_predictions") >= 5) & F.col("latitude").isNotNull())
    sp = top(sp, limit, F.col(_sort_col(sort_by)).desc_nulls_last(), F.col("stop_id").asc())
    return sp.select("stop_id", "stop_name", "municipality", "latitude", "longitude",
                     "total_predictions", "routes_served", "avg_delay_seconds",
                     minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                     rha(F.lit(100.0) - F.col("late_pct"), 1).alias("on_time_pct"), "late_pct",
                     "significant_delay_pct", "p90_delay_seconds", "delay_hotspot_score",
                     "total_vehicle_visits", "avg_occupancy_pct")
