"""Temporal queries (N23, N32–N35) over the delay mart and delay model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import avg_fixed, day_of_week, hour_of, round_half_away as rha
from transitlake.functions.labels import day_name
from transitlake.plans.queries.common import minutes, opt_eq, top

# Display order of the real period labels.
PERIOD_ORDER = ["morning_rush", "midday", "evening_rush", "evening", "overnight"]


def scatter_day_of_week(m, route_filter: str = "all", sample_size: int = 500,
                        seed: int = 42) -> DataFrame:
    """A seeded sample of delay observations (weekday, route, minutes, hour).

    The sample is the ``sample_size`` rows with the smallest md5 of row key
    and seed: uniform, reproducible, and independent of partitioning (a
    per-row ``rand()`` would change with the layout).
    """
    s = opt_eq(m.scheduled_vs_actual, "route_id", route_filter)
    k = F.md5(F.concat_ws("|", "prediction_id", "trip_id", "stop_id", F.col("service_date").cast("string"),
                          F.lit(str(int(seed)))).cast("binary"))
    s = s.select(day_name(day_of_week("service_date")).alias("day_of_week"), "route_id",
                 minutes("delay_seconds").alias("delay_minutes"),
                 hour_of(F.coalesce("scheduled_arrival", "scheduled_departure")).alias("hour"),
                 k.alias("_k"))
    return top(s, sample_size, F.col("_k")).drop("_k")


def _measures(on_time: bool = False):
    cols = [minutes(avg_fixed("avg_delay_seconds", 1)).alias("avg_delay_minutes"),
            minutes(avg_fixed("median_delay_seconds", 1)).alias("median_delay_minutes"),
            F.sum("prediction_count").alias("trip_count")]
    if on_time:
        cols.append(rha(avg_fixed("on_time_pct", 2), 1).alias("on_time_pct"))
    cols.append(rha(avg_fixed("late_pct", 2), 1).alias("pct_late"))
    return cols


def day_of_week_profile(m, route_filter: str = "all") -> DataFrame:
    d = opt_eq(m.delay_analysis, "route_id", route_filter)
    g = d.groupBy("day_of_week").agg(*_measures())
    return g.select(day_name("day_of_week").alias("day_of_week"),
                    F.col("day_of_week").alias("day_num"), "avg_delay_minutes",
                    "median_delay_minutes", "trip_count", "pct_late")


def delay_probability(m, route_filter: str = "all") -> DataFrame:
    d = opt_eq(m.delay_analysis, "route_id", route_filter)
    return (d.groupBy(F.col("hour_of_day").alias("hour"))
            .agg(rha(avg_fixed("significant_delay_pct", 2), 1).alias("delay_probability"),
                 F.sum("prediction_count").alias("trip_count"),
                 minutes(avg_fixed("avg_delay_seconds", 1)).alias("avg_delay_minutes")))


def hourly(m, route_filter: str = "all", day_type: str = "all") -> DataFrame:
    d = opt_eq(opt_eq(m.delay_analysis, "route_id", route_filter), "day_type", day_type)
    return (d.groupBy(F.col("hour_of_day").alias("hour"), "day_type", "time_period")
            .agg(*_measures()))


def rush_hour(m, route_filter: str = "all") -> DataFrame:
    d = opt_eq(m.delay_analysis, "route_id", route_filter)
    g = d.groupBy("time_period").agg(*_measures(on_time=True))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PERIOD_ORDER]),
                                       F.col("time_period")), F.lit(len(PERIOD_ORDER) + 1))
    return g.orderBy(rank)
