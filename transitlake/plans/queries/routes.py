"""Route queries over the reliability and delay marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import avg_fixed, round_half_away as rha
from transitlake.plans.queries.common import minutes, top

MODE_ALIASES = {"subway": "heavy_rail"}


def reliability_trend(m) -> DataFrame:
    r = m.route_reliability
    return r.select("route_id", "route_name", rha("on_time_pct", 1).alias("on_time_pct"),
                    minutes("avg_delay_seconds").alias("avg_delay_minutes"), "total_predictions")


def ranking(m) -> DataFrame:
    r = m.route_reliability
    return r.select("route_id", "route_name", "route_type_desc", "total_predictions",
                    rha("on_time_pct", 1).alias("on_time_pct"),
                    minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                    rha("reliability_score", 1).alias("reliability_score"))


def ranking_filtered(m, mode: str = "all", limit: int = 10) -> DataFrame:
    """Top routes by on-time % within a mode (``light_rail``, ``bus``, …;
    ``subway`` is read as heavy rail)."""
    r = m.route_reliability
    if mode and mode.lower() != "all":
        want = MODE_ALIASES.get(mode.lower(), mode.lower())
        r = r.filter(F.lower(F.regexp_replace("route_type_desc", " ", "_")) == want)
    r = r.select("route_id", "route_name", "route_type", "route_type_desc", "total_predictions",
                 "on_time_pct", minutes("avg_delay_seconds").alias("avg_delay_minutes"),
                 "reliability_score")
    return top(r, limit, F.col("on_time_pct").desc_nulls_last(), F.col("route_id").asc())


def detail(m, route_id: str) -> DataFrame:
    r = m.route_reliability.filter(F.col("route_id") == route_id)
    return r.select(
        "route_id", "route_name", "route_type_desc", "total_predictions",
        rha("on_time_pct", 1).alias("on_time_pct"),
        minutes("avg_delay_seconds").alias("avg_delay_minutes"),
        minutes("median_delay_seconds").alias("median_delay_minutes"),
        minutes("stddev_delay_seconds").alias("stddev_delay_minutes"),
        minutes("p75_delay_seconds").alias("p75_delay_minutes"),
        minutes("p90_delay_seconds").alias("p90_delay_minutes"),
        minutes("p95_delay_seconds").alias("p95_delay_minutes"),
        "min_delay_seconds", "max_delay_seconds",
        rha("reliability_score", 1).alias("reliability_score"),
        "early_count", "on_time_strict_count", "slightly_late_count", "late_count",
        "very_late_count", rha("significant_delay_pct", 1).alias("significant_delay_pct"))


def hourly(m, route_id: str) -> DataFrame:
    d = m.delay_analysis.filter(F.col("route_id") == route_id)
    return (d.groupBy(F.col("hour_of_day").alias("hour"), "time_period")
            .agg(minutes(avg_fixed("avg_delay_seconds", 1)).alias("avg_delay_minutes"),
                 F.sum("prediction_count").alias("trip_count"),
                 rha(avg_fixed("on_time_pct", 2), 1).alias("on_time_pct"),
                 rha(avg_fixed("late_pct", 2), 1).alias("pct_late")))


def reliability_list(m) -> DataFrame:
    r = m.route_reliability
    return r.select(
        "route_id", "route_name", "route_type_desc", "total_predictions",
        rha("on_time_pct", 1).alias("on_time_pct"),
        minutes("avg_delay_seconds").alias("avg_delay_minutes"),
        minutes("median_delay_seconds").alias("median_delay_minutes"),
        minutes("p90_delay_seconds").alias("p90_delay_minutes"),
        rha("significant_delay_pct", 1).alias("significant_delay_pct"),
        rha("reliability_score", 1).alias("reliability_score"),
        "early_count", "on_time_strict_count", "slightly_late_count", "late_count",
        "very_late_count")
