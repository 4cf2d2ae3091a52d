"""Heatmap queries over the delay mart and the delay model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import avg_fixed, hour_of, round_half_away as rha
from transitlake.functions.labels import DAY_NAMES, day_name
from transitlake.plans.queries.common import minutes, opt_eq, top


def _mart_measures():
    return [minutes(avg_fixed("avg_delay_seconds", 1)).alias("avg_delay_minutes"),
            minutes(avg_fixed("median_delay_seconds", 1)).alias("median_delay_minutes"),
            F.sum("prediction_count").alias("trip_count"),
            rha(avg_fixed("late_pct", 2), 1).alias("pct_late")]


def cell_history(m, route_id: str, hour: int, days: int = 30) -> DataFrame:
    """Daily average delay of one route at one scheduled hour, latest days first."""
    s = m.scheduled_vs_actual.filter(
        (F.col("route_id") == route_id)
        & (hour_of(F.coalesce("scheduled_arrival", "scheduled_departure")) == int(hour)))
    g = s.groupBy("service_date").agg(minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"))
    g = top(g, days, F.col("service_date").desc())
    return g.select(F.col("service_date").cast("string").alias("date"), "avg_delay_minutes")


def cell_stations(m, route_id: str, limit: int = 20) -> DataFrame:
    """Worst stops (by average delay) among those the route serves."""
    served = m.scheduled_vs_actual.filter(F.col("route_id") == route_id).select("stop_id")
    sp = m.stop_performance.join(served, "stop_id", "left_semi")
    sp = top(sp, limit, F.col("avg_delay_seconds").desc_nulls_last(), F.col("stop_id").asc())
    return sp.select(F.col("stop_name").alias("station_name"),
                     minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                     F.col("total_predictions").alias("trip_count"),
                     rha("late_pct", 1).alias("pct_late"))


def _day_num(day) -> int:
    if isinstance(day, str) and not day.isdigit():
        inv = {v.lower(): k for k, v in DAY_NAMES.items()}
        return inv[day.lower()]
    return int(day)


def cell_summary(m, route_id: str, day_of_week, hour: int) -> DataFrame:
    """One heatmap cell (route × weekday × hour); weekday as name or 1–7."""
    d = m.delay_analysis.filter((F.col("route_id") == route_id)
                                & (F.col("day_of_week") == _day_num(day_of_week))
                                & (F.col("hour_of_day") == int(hour)))
    return d.agg(*_mart_measures())


def day_hour(m, route_filter: str = "all", direction: str = "all") -> DataFrame:
    """Weekday × hour grid of (unweighted) mart averages."""
    d = opt_eq(m.delay_analysis, "route_id", route_filter)
    if direction == "inbound":
        d = d.filter(F.col("direction_id") == 1)
    elif direction == "outbound":
        d = d.filter(F.col("direction_id") == 0)
    g = d.groupBy("day_of_week", "hour_of_day").agg(*_mart_measures())
    return g.select(day_name("day_of_week").alias("day_of_week"),
                    F.col("day_of_week").alias("day_num"), F.col("hour_of_day").alias("hour"),
                    "avg_delay_minutes", "median_delay_minutes", "trip_count", "pct_late")
