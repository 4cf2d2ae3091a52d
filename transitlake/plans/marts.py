"""Marts: route reliability, stop performance, delay patterns, alert summary.

Percentiles are exact (``percentile`` keeps a value→count map per group;
delays are whole seconds in [−1800, 3600], so the map holds at most 5,401
entries whatever the row count and is merged map-side like any partial
aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import day_of_week, hour_of, is_weekend, round_half_away
from transitlake.functions.labels import ALERT_EFFECT_MULTIPLIER, time_period


def _share(cond: Column) -> Column:
    return F.lit(100.0) * F.count_if(cond) / F.count(F.lit(1))


def route_reliability(sva: DataFrame) -> DataFrame:
    d = F.col("delay_seconds")
    agg = (sva.filter(d.isNotNull())
           .groupBy("route_id", "route_name", "route_type", "route_type_desc")
           .agg(F.count(F.lit(1)).alias("total_predictions"),
                F.count_if(~F.col("is_late")).alias("on_time_count"),
                round_half_away(_share(~F.col("is_late")), 2).alias("on_time_pct"),
                round_half_away(F.avg(d), 1).alias("avg_delay_seconds"),
                F.percentile(d, F.array(*[F.lit(p) for p in (0.5, 0.75, 0.9, 0.95)])).alias("_q"),
                round_half_away(F.stddev(d), 1).alias("stddev_delay_seconds"),
                F.min(d).alias("min_delay_seconds"),
                F.max(d).alias("max_delay_seconds"),
                F.count_if(F.col("delay_category") == "early").alias("early_count"),
                F.count_if(F.col("delay_category") == "on_time").alias("on_time_strict_count"),
                F.count_if(F.col("delay_category") == "slightly_late").alias("slightly_late_count"),
                F.count_if(F.col("delay_category") == "late").alias("late_count"),
                F.count_if(F.col("delay_category") == "very_late").alias("very_late_count"),
                round_half_away(_share(F.col("is_significantly_late")), 2).alias("significant_delay_pct")))
    q = F.col("_q")
    score = round_half_away(
        F.col("on_time_pct") * 0.5
        + (F.lit(100.0) - F.least(F.col("significant_delay_pct") * 5, F.lit(100.0))) * 0.3
        + (F.lit(100.0) - F.least(F.abs(F.col("avg_delay_seconds")) / 6.0, F.lit(100.0))) * 0.2, 1)
    return agg.select(
        "route_id", "route_name", "route_type", "route_type_desc", "total_predictions",
        "on_time_count", "on_time_pct", "avg_delay_seconds",
        round_half_away(q[0], 1).alias("median_delay_seconds"),
        "stddev_delay_seconds", "min_delay_seconds", "max_delay_seconds",
        round_half_away(q[1], 1).alias("p75_delay_seconds"),
        round_half_away(q[2], 1).alias("p90_delay_seconds"),
        round_half_away(q[3], 1).alias("p95_delay_seconds"),
        "early_count", "on_time_strict_count", "slightly_late_count", "late_count",
        "very_late_count", "significant_delay_pct", score.alias("reliability_score"))


def stop_performance(sva: DataFrame, stop_activity: DataFrame) -> DataFrame:
    d = F.col("delay_seconds")
    delay = (sva.filter(d.isNotNull())
             .groupBy("stop_id", "stop_name", "municipality", "latitude", "longitude")
             .agg(F.count(F.lit(1)).alias("total_predictions"),
                  F.countDistinct("route_id").alias("routes_served"),
                  round_half_away(F.avg(d), 1).alias("avg_delay_seconds"),
                  F.percentile(d, F.array(F.lit(0.5), F.lit(0.9))).alias("_q"),
                  round_half_away(_share(F.col("is_late")), 2).alias("late_pct"),
                  round_half_away(_share(F.col("is_significantly_late")), 2).alias("significant_delay_pct")))
    delay = delay.select(
        "stop_id", "stop_name", "municipality", "latitude", "longitude", "total_predictions",
        "routes_served", "avg_delay_seconds",
        round_half_away(F.col("_q")[0], 1).alias("median_delay_seconds"),
        "late_pct", "significant_delay_pct",
        round_half_away(F.col("_q")[1], 1).alias("p90_delay_seconds"))
    veh = (stop_activity.groupBy("stop_id")
           .agg(F.sum("vehicle_count").alias("total_vehicle_visits"),
                round_half_away(F.avg("mean_occupancy_pct"), 2).alias("avg_occupancy_pct"),
                F.max("max_occupancy_pct").alias("peak_occupancy_pct")))
    score = round_half_away(
        F.coalesce("late_pct", F.lit(0.0)) * 0.4
        + F.coalesce("significant_delay_pct", F.lit(0.0)) * 0.3
        + F.least(F.abs(F.coalesce("avg_delay_seconds", F.lit(0.0))) / 3.0, F.lit(100.0)) * 0.3, 1)
    return delay.join(veh, "stop_id", "left").withColumn("delay_hotspot_score", score)


def delay_analysis(sva: DataFrame, tz: str = "UTC", local_hours: bool = False) -> DataFrame:
    """Delay measures over route × direction × hour × weekday × day type × period.

    ``local_hours=False`` takes the hour of the UTC instant, as the source
    model does; ``True`` uses the wall clock of ``tz``.
    """
    d = F.col("delay_seconds")
    hour = hour_of(F.coalesce("predicted_arrival", "predicted_departure"),
                   tz if local_hours else "UTC")
    base = (sva.filter(d.isNotNull())
            .withColumn("hour_of_day", hour)
            .withColumn("day_of_week", day_of_week("service_date"))
            .withColumn("day_type", F.when(is_weekend("service_date"), F.lit("weekend"))
                        .otherwise(F.lit("weekday")))
            .withColumn("time_period", time_period(F.col("hour_of_day"))))
    cat = F.col("delay_category")
    return (base.groupBy("route_id", "route_name", "route_type_desc", "direction_id",
                         "hour_of_day", "day_of_week", "day_type", "time_period")
            .agg(F.count(F.lit(1)).alias("prediction_count"),
                 round_half_away(F.avg(d), 1).alias("avg_delay_seconds"),
                 round_half_away(F.median(d), 1).alias("median_delay_seconds"),
                 round_half_away(F.stddev(d), 1).alias("stddev_delay_seconds"),
                 round_half_away(_share(~F.col("is_late")), 2).alias("on_time_pct"),
                 round_half_away(_share(F.col("is_late")), 2).alias("late_pct"),
                 round_half_away(_share(F.col("is_significantly_late")), 2).alias("significant_delay_pct"),
                 F.count_if(cat == "early").alias("early_count"),
                 F.count_if(cat == "on_time").alias("on_time_count"),
                 F.count_if(cat == "slightly_late").alias("slightly_late_count"),
                 F.count_if(cat == "late").alias("late_count"),
                 F.count_if(cat == "very_late").alias("very_late_count")))


def effect_multiplier(effect) -> Column:
    e = F.col(effect) if isinstance(effect, str) else effect
    out = None
    for m, effects in ALERT_EFFECT_MULTIPLIER:
        out = F.when(e.isin(*effects), F.lit(m)) if out is None else out.when(e.isin(*effects), F.lit(m))
    return out.otherwise(F.lit(1.0))


def alert_summary(alert_impacts: DataFrame) -> DataFrame:
    impact = round_half_away(
        F.col("severity") * (F.lit(1.0) + F.log(F.lit(1.0) + F.col("informed_entity_count")))
        * effect_multiplier("effect"), 2)
    return alert_impacts.select(
        "alert_id", "cause", "effect", "severity", "severity_category", "lifecycle", "header",
        "service_effect", "is_active", "active_start", "active_end", "duration_hours",
        "affected_routes", "affected_stops", "informed_entity_count",
        F.array_size("affected_routes").alias("affected_route_count"),
        F.array_size("affected_stops").alias("affected_stop_count"),
        impact.alias("impact_score"), "created_at", "updated_at")
