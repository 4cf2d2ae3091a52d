"""System overview queries.

"Now" is always an argument. One-row aggregates are combined with scalar
subqueries (``DataFrame.scalar()``), never with cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import (
    lit_ts, round_half_away as rha, safe_divide, service_date, service_seconds,
)
from transitlake.plans.queries.common import minutes

TS_FMT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def performance_trends(m, day_type: str = "weekday") -> DataFrame:
    """Hourly on-time % and delay per mode, weighted by prediction counts."""
    d = m.delay_analysis.filter(F.col("day_type") == day_type)
    pc = F.col("prediction_count")
    return (d.groupBy("hour_of_day", F.col("route_type_desc").alias("mode"))
            .agg(F.sum(pc).alias("trips"),
                 rha(safe_divide(F.sum(pc * F.col("on_time_pct")), F.sum(pc)), 1).alias("on_time_pct"),
                 minutes(safe_divide(F.sum(pc * F.col("avg_delay_seconds")), F.sum(pc))).alias("avg_delay_minutes")))


def schedule_base(m, tz: str = "UTC") -> DataFrame:
    """Scheduled departures with their service date and service-day second."""
    s = m.raw.schedules.filter(F.col("departure_time").isNotNull())
    dep = F.col("departure_time").cast("timestamp")
    return s.select("route_id", "trip_id", service_date(dep, tz).alias("service_date"),
                    service_seconds(dep, tz).alias("service_seconds"))


class _Clock:
    def __init__(self, now, tz: str):
        n = lit_ts(now)
        self.service_date = service_date(n, tz)
        self.service_seconds = service_seconds(n, tz)
        self.now = n


def _selected_day(sb: DataFrame, clock: _Clock) -> DataFrame:
    return sb.filter(F.col("service_date") <= clock.service_date).agg(
        F.max("service_date").alias("service_date"))


def _performance(m, day) -> DataFrame:
    s = m.scheduled_vs_actual.filter(F.col("service_date") == day)
    return s.agg(F.count(F.lit(1)).alias("prediction_events"),
                 F.count_if(F.col("delay_category").isin("early", "on_time")).alias("on_time_events"),
                 F.avg("delay_seconds").alias("avg_delay_seconds"))


def _perf_cols():
    return [rha(safe_divide(F.col("on_time_events") * 100.0, F.col("prediction_events")), 1).alias("on_time_pct"),
            minutes("avg_delay_seconds").alias("avg_delay_minutes")]


def system(m, now, tz: str = "UTC") -> DataFrame:
    """On-time %, delay and trip count of the latest scheduled service day ≤ now."""
    clock = _Clock(now, tz)
    sb = schedule_base(m, tz)
    day = _selected_day(sb, clock).scalar()
    trips = sb.filter(F.col("service_date") == day).agg(F.countDistinct("trip_id")).scalar()
    active = m.alert_summary.filter(F.col("is_active")).agg(F.count(F.lit(1))).scalar()
    return _performance(m, day).select(
        *_perf_cols(), trips.alias("total_trips"), active.alias("active_alerts"),
        F.date_format(clock.now, TS_FMT).alias("last_updated"))


def system_enhanced(m, now, tz: str = "UTC") -> DataFrame:
    """As ``system`` but trips only up to the current service second, alert
    counts by severity band and feed freshness."""
    clock = _Clock(now, tz)
    sb = schedule_base(m, tz)
    day = _selected_day(sb, clock).scalar()
    trips = (sb.filter((F.col("service_date") == day)
                       & (F.col("service_seconds") <= clock.service_seconds))
             .agg(F.countDistinct("trip_id")).scalar())
    a = m.alert_summary
    act, sev = F.col("is_active"), F.col("severity")
    alerts = a.agg(F.count_if(act).alias("active_alerts"),
                   F.count_if(act & (sev >= 7)).alias("critical_alerts"),
                   F.count_if(act & (sev >= 4) & (sev < 7)).alias("major_alerts"),
                   F.count_if(act & (sev >= 1) & (sev < 4)).alias("minor_alerts"),
                   F.count_if(act & ((sev < 1) | sev.isNull())).alias("info_alerts"))
    fresh = m.raw.predictions.agg(F.max(F.col("extracted_at").cast("timestamp"))).scalar()
    perf = _performance(m, day)
    return perf.select(
        clock.service_date.alias("current_service_date"), day.alias("selected_service_date"),
        trips.alias("total_trips"), *_perf_cols(),
        *[alerts.select(c).scalar().alias(c) for c in
          ("active_alerts", "critical_alerts", "major_alerts", "minor_alerts", "info_alerts")],
        fresh.alias("last_updated"))


def system_previous_day(m, now, tz: str = "UTC") -> DataFrame:
    """The same measures for the scheduled service day before the selected one."""
    clock = _Clock(now, tz)
    sb = schedule_base(m, tz)
    day = _selected_day(sb, clock).scalar()
    prev = sb.filter(F.col("service_date") < day).agg(F.max("service_date")).scalar()
    trips = (sb.filter((F.col("service_date") == prev)
                       & (F.col("service_seconds") <= clock.service_seconds))
             .agg(F.countDistinct("trip_id")).scalar())
    active = m.alert_summary.agg(F.count_if(F.col("is_active"))).scalar()
    return _performance(m, prev).select(
        trips.alias("total_trips"), *_perf_cols(), active.alias("active_alerts"),
        F.date_format(clock.now, TS_FMT).alias("last_updated"))


def trips_by_mode(m, now, tz: str = "UTC") -> DataFrame:
    """Distinct trips scheduled so far on the selected service day, per mode."""
    clock = _Clock(now, tz)
    sb = schedule_base(m, tz)
    day = _selected_day(sb, clock).scalar()
    s = sb.filter((F.col("service_date") == day)
                  & (F.col("service_seconds") <= clock.service_seconds))
    routes = F.broadcast(m.raw.routes.select("route_id", "route_type_desc"))
    return (s.join(routes, "route_id", "inner")
            .groupBy(F.col("route_type_desc").alias("mode"))
            .agg(F.countDistinct("trip_id").alias("trips")))


def quality_overview(m) -> DataFrame:
    """Row counts (and distinct routes) of the four marts."""
    def part(name, df, routes: bool):
        u = F.countDistinct("route_id") if routes else F.lit(0).cast("long")
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                      u.alias("unique_routes"))
    return (part("mart_delay_analysis", m.delay_analysis, True)
            .unionByName(part("mart_route_reliability", m.route_reliability, True))
            .unionByName(part("mart_stop_performance", m.stop_performance, False))
            .unionByName(part("mart_alert_summary", m.alert_summary, False)))
