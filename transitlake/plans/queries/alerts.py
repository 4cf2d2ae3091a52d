"""Alert queries: active alerts (N1), alerts by mode (N2), quality list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import lit_ts, round_half_away as rha, to_ts
from transitlake.functions.labels import severity_category
from transitlake.plans.queries.common import top


def alerts_active(m, now, severity: str = "all", limit: int = 50) -> DataFrame:
    """Alerts active at ``now``: not deleted/ended/closed and inside their
    window (open ends allowed), ranked by the live impact score
    5·severity + 2·routes + 0.25·stops.

    ``stg_alerts`` already holds one (latest) version per alert, so the
    source's second latest-per-id pass is the identity and is not repeated.
    """
    now_c = lit_ts(now)
    rc, sc = F.array_size("affected_routes"), F.array_size("affected_stops")
    a = m.stg_alerts.select(
        "alert_id", "cause", "effect", "severity",
        severity_category("severity", "live").alias("severity_category"),
        "header", "service_effect", "lifecycle", "active_start", "active_end",
        "duration_certainty", "affected_routes", "affected_stops",
        rc.alias("affected_route_count"), sc.alias("affected_stop_count"),
        "created_at", "updated_at", "closed_timestamp",
        (F.coalesce(F.col("severity"), F.lit(0)) * 5 + rc * 2 + sc * 0.25).alias("impact_score"))
    a = a.filter(~F.lower(F.coalesce("lifecycle", F.lit(""))).isin("deleted", "ended")
                 & F.col("closed_timestamp").isNull()
                 & (F.col("active_start").isNull() | (F.col("active_start") <= now_c))
                 & (F.col("active_end").isNull() | (F.col("active_end") > now_c)))
    if severity and severity.lower() != "all":
        a = a.filter(F.lower("severity_category") == severity.lower())
    a = a.select("alert_id", "cause", "effect", "severity", "severity_category", "header",
                 "service_effect", F.lit(True).alias("is_active"), "active_start", "active_end",
                 "affected_routes", "affected_stops", "affected_route_count",
                 "affected_stop_count", "impact_score", "created_at", "updated_at")
    return top(a, limit, F.col("impact_score").desc_nulls_last(),
               F.col("updated_at").desc_nulls_last(), F.col("alert_id").asc())


def alerts_by_mode(m, now) -> DataFrame:
    """Distinct raw alert versions active at ``now`` per transit mode."""
    now_c = lit_ts(now)
    a = m.raw.alerts
    a = a.filter((to_ts("active_start") <= now_c)
                 & (F.col("active_end").isNull() | (to_ts("active_end") >= now_c)))
    ar = a.select("alert_id", F.explode("affected_routes").alias("route_id"))
    routes = F.broadcast(m.raw.routes.select("route_id", "route_type_desc"))
    return (ar.join(routes, "route_id", "left")
            .groupBy(F.coalesce("route_type_desc", F.lit("Unknown")).alias("mode"))
            .agg(F.countDistinct("alert_id").alias("alert_count")))


def quality_alerts(m, limit: int = 50) -> DataFrame:
    """Top active alerts of the summary mart by impact."""
    s = m.alert_summary.filter(F.col("is_active"))
    s = s.select("alert_id", "header", "cause", "effect", "severity_category", "service_effect",
                 rha("duration_hours", 1).alias("duration_hours"), "affected_route_count",
                 "affected_stop_count", rha("impact_score", 2).alias("impact_score"),
                 "is_active",
                 F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return top(s, limit, F.col("impact_score").desc_nulls_last(), F.col("alert_id").asc())
