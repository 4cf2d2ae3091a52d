"""Weather queries (N40–N47) over raw weather and the weather-exposure model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import day_of_week, round_half_away as rha, safe_divide
from transitlake.functions.labels import day_name, weather_condition
from transitlake.plans.queries.common import minutes, opt_eq, top


def current(m) -> DataFrame:
    """Latest observation in imperial units (code 1 counts as Clear here)."""
    w = m.raw.weather
    w = w.select(rha(F.col("temperature_2m") * 9.0 / 5.0 + 32.0, 1).alias("temp_f"),
                 F.col("relative_humidity_2m").alias("humidity"),
                 rha(F.col("wind_speed_10m") * 0.621371, 1).alias("wind_mph"),
                 rha(F.col("precipitation") / 25.4, 3).alias("precip_in"), "weather_code",
                 weather_condition("weather_code", "current").alias("condition"),
                 F.col("timestamp").cast("timestamp").alias("timestamp"))
    return top(w, 1, F.col("timestamp").desc_nulls_last())


def _wt(m, route_filter="all") -> DataFrame:
    return opt_eq(m.weather_transit, "route_id", route_filter)


def day_matrix(m, route_filter: str = "all") -> DataFrame:
    w = _wt(m, route_filter).filter(F.col("weather_condition").isNotNull())
    dn = day_name(day_of_week(F.coalesce("predicted_arrival", "predicted_departure")))
    return (w.groupBy(F.col("weather_condition").alias("condition"), dn.alias("day_of_week"))
            .agg(minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"),
                 F.count(F.lit(1)).alias("trip_count")))


def _env():
    return [rha(F.avg("temperature_f"), 1).alias("avg_temp"),
            rha(F.avg("wind_speed_mph"), 1).alias("avg_wind"),
            rha(F.avg("precipitation_mm"), 2).alias("avg_precip")]


def delay_impact(m) -> DataFrame:
    """Delay by first-matching weather condition category."""
    w = _wt(m).filter(F.col("delay_seconds").isNotNull())
    t = F.col("temperature_f")
    cat = (F.when(F.col("is_precipitation"), F.lit("Precipitation"))
           .when(F.col("is_high_wind"), F.lit("High Wind"))
           .when(t < 32, F.lit("Freezing")).when(t > 90, F.lit("Extreme Heat"))
           .when(F.col("is_low_visibility"), F.lit("Low Visibility")).otherwise(F.lit("Normal")))
    return (w.groupBy(cat.alias("condition_category"))
            .agg(F.count(F.lit(1)).alias("observation_count"),
                 minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"),
                 F.countDistinct("route_id").alias("routes_affected"), *_env()))


def overview(m, route_filter: str = "all") -> DataFrame:
    w = _wt(m, route_filter).filter(F.col("weather_condition").isNotNull())
    d = F.col("delay_seconds")
    return (w.groupBy(F.col("weather_condition").alias("condition"))
            .agg(minutes(F.avg(d)).alias("avg_delay_minutes"),
                 F.count(F.lit(1)).alias("trip_count"),
                 rha(safe_divide(F.count_if(d > 300), F.count(F.lit(1))) * 100, 1).alias("pct_late"),
                 *_env()))


def route_vulnerability(m) -> DataFrame:
    w = _wt(m).filter(F.col("weather_condition").isNotNull())
    d = F.col("delay_seconds")
    cavg = lambda cond: minutes(F.avg(F.when(cond, d)))
    return (w.groupBy("route_id")
            .agg(cavg(F.col("weather_condition") == "Clear").alias("clear_avg"),
                 cavg(F.col("is_snow")).alias("snow_avg"),
                 cavg(F.col("is_precipitation")).alias("precip_avg"),
                 cavg(F.col("is_high_wind")).alias("wind_avg"),
                 F.count(F.lit(1)).alias("total_trips")))


def scatter_precip(m, route_filter: str = "all", precip_type: str = "all") -> DataFrame:
    w = _wt(m, route_filter).filter(F.col("precipitation_mm") > 0)
    if precip_type == "rain":
        w = w.filter(~F.col("is_snow"))
    elif precip_type == "snow":
        w = w.filter(F.col("is_snow"))
    return (w.groupBy(rha("precipitation_mm", 1).alias("precipitation_mm"), "weather_condition")
            .agg(minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"),
                 F.count(F.lit(1)).alias("trip_count")))


def scatter_temp(m, route_filter: str = "all") -> DataFrame:
    w = _wt(m, route_filter).filter(F.col("temperature_f").isNotNull()
                                    & F.col("delay_seconds").isNotNull())
    return (w.groupBy(rha("temperature_f", 0).alias("temperature_f"))
            .agg(minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"),
                 F.count(F.lit(1)).alias("trip_count")))


def scatter_wind(m, route_filter: str = "all") -> DataFrame:
    w = _wt(m, route_filter).filter(F.col("wind_speed_mph").isNotNull())
    return (w.groupBy(rha("wind_speed_mph", 0).alias("wind_speed_mph"), "route_id")
            .agg(minutes(F.avg("delay_seconds")).alias("avg_delay_minutes"),
                 F.count(F.lit(1)).alias("trip_count")))
