"""Derived analytics (O1–O21): the post-processing the serving layer and
notebooks did in Python, expressed as DataFrame plans over query outputs.

Arg-max / arg-min use ``max_by`` / ``min_by`` with a tie-breaking struct
(first in display order wins, as the source's ``max(rows)`` does); shares
use a window over the (small) aggregated result; pivots list their values
up front so no extra job discovers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.core import avg_fixed, round_half_away as rha, safe_divide
from transitlake.functions.labels import (
    ROUTE_TYPE_NAMES, health_label, reliability_label, risk_level,
)
from transitlake.plans.queries import alerts as qa
from transitlake.plans.queries import heatmap as qh
from transitlake.plans.queries import overview as qo
from transitlake.plans.queries import temporal as qt
from transitlake.plans.queries import trips as qtr
from transitlake.plans.queries import weather as qw

# Trip-planner defaults for a route without reliability data (fixed values).
DEFAULT_ON_TIME, DEFAULT_DELAY_MIN, DEFAULT_RISK = 70.0, 2.0, 10.0


def heatmap_anomalies(m, route_filter="all", direction="all") -> DataFrame:
    """O1: each day×hour cell flagged when > 2× the mean of its hour."""
    cells = qh.day_hour(m, route_filter, direction)
    mean = F.avg("avg_delay_minutes").over(Window.partitionBy("hour"))
    return cells.withColumn("is_anomaly", F.col("avg_delay_minutes") > F.lit(2.0) * mean)


def heatmap_summary(m, route_filter="all", direction="all") -> DataFrame:
    """O1: worst / best cell (first in day, hour order on ties) and total trips."""
    c = qh.day_hour(m, route_filter, direction)
    cell = F.struct("day_of_week", "hour", "avg_delay_minutes")
    return c.agg(
        F.max_by(cell, F.struct("avg_delay_minutes", -F.col("day_num"), -F.col("hour"))).alias("worst"),
        F.min_by(cell, F.struct("avg_delay_minutes", "day_num", "hour")).alias("best"),
        F.sum("trip_count").alias("total_trips"),
    ).select(F.col("worst.day_of_week").alias("worst_day"), F.col("worst.hour").alias("worst_hour"),
             F.col("worst.avg_delay_minutes").alias("worst_avg_delay_minutes"),
             F.col("best.day_of_week").alias("best_day"), F.col("best.hour").alias("best_hour"),
             F.col("best.avg_delay_minutes").alias("best_avg_delay_minutes"), "total_trips")


def weekday_insight(m, route_filter="all") -> DataFrame:
    """O2: worst / best weekday, trip-weighted system mean, % above it."""
    d = qt.day_of_week_profile(m, route_filter)
    a = d.agg(
        F.max_by(F.struct("day_of_week", "avg_delay_minutes"),
                 F.struct("avg_delay_minutes", -F.col("day_num"))).alias("w"),
        F.min_by(F.struct("day_of_week", "avg_delay_minutes"),
                 F.struct("avg_delay_minutes", "day_num")).alias("b"),
        (F.sum(F.col("avg_delay_minutes") * F.col("trip_count")) / F.sum("trip_count")).alias("system_avg"))
    sa = F.col("system_avg")
    return a.select(
        F.col("w.day_of_week").alias("worst_day"), F.col("w.avg_delay_minutes").alias("worst_avg_delay_minutes"),
        F.col("b.day_of_week").alias("best_day"), F.col("b.avg_delay_minutes").alias("best_avg_delay_minutes"),
        rha(sa, 3).alias("system_avg_minutes"),
        rha(F.when(sa != 0, (F.col("w.avg_delay_minutes") - sa) / sa * 100).otherwise(F.lit(0.0)), 0)
        .alias("worst_pct_above"))


def overview_deltas(m, now, tz="UTC") -> DataFrame:
    """O3: selected vs previous service day; a missing previous value
    falls back to the current one (change 0)."""
    cur = qo.system_enhanced(m, now, tz)
    prev = qo.system_previous_day(m, now, tz)
    p = {c: prev.select(c).scalar() for c in ("on_time_pct", "avg_delay_minutes", "total_trips", "active_alerts")}
    pot = F.coalesce(p["on_time_pct"], F.col("on_time_pct"))
    pdl = F.coalesce(p["avg_delay_minutes"], F.col("avg_delay_minutes"))
    ptr = F.coalesce(p["total_trips"], F.col("total_trips"))
    pal = F.coalesce(p["active_alerts"], F.col("active_alerts"))
    return cur.select(
        "total_trips", "on_time_pct", "avg_delay_minutes", "active_alerts", "critical_alerts",
        "major_alerts", "minor_alerts", "info_alerts",
        rha(F.col("on_time_pct") - pot, 1).alias("on_time_pct_change"),
        rha(F.col("avg_delay_minutes") - pdl, 1).alias("avg_delay_change"),
        (F.col("total_trips") - ptr).alias("total_trips_change"),
        rha(F.when(ptr > 0, (F.col("total_trips") - ptr) / ptr * 100).otherwise(F.lit(0.0)), 1)
        .alias("trips_change_pct"),
        (F.col("active_alerts") - pal).alias("active_alerts_change"))


def mode_health(m) -> DataFrame:
    """Per-mode on-time % and delay weighted by observations; health label."""
    r = m.route_reliability
    tp = F.col("total_predictions")
    g = r.groupBy(F.col("route_type_desc").alias("mode")).agg(
        F.sum(tp).alias("observations"),
        rha(safe_divide(F.sum(F.col("on_time_pct") * tp), F.sum(tp)), 1).alias("on_time_pct"),
        rha(safe_divide(F.sum(F.col("avg_delay_seconds") * tp), F.sum(tp)) / 60.0, 1).alias("avg_delay_minutes"),
        F.count(F.lit(1)).alias("routes"))
    return g.withColumn("health", health_label("on_time_pct"))


def performance_pivot(m, day_type="weekday") -> DataFrame:
    """On-time % by hour with one column per mode plus a trip-weighted
    'all modes' column."""
    t = qo.performance_trends(m, day_type)
    modes = list(ROUTE_TYPE_NAMES.values())
    piv = t.groupBy("hour_of_day").pivot("mode", modes).agg(F.first("on_time_pct"))
    allm = t.groupBy("hour_of_day").agg(
        rha(safe_divide(F.sum(F.col("on_time_pct") * F.col("trips")), F.sum("trips")), 1).alias("all_modes"))
    out = piv.join(allm, "hour_of_day")
    return out.select("hour_of_day", *[F.col(f"`{mo}`").alias(mo.lower().replace(" ", "_")) for mo in modes],
                      "all_modes")


def mode_share(m, now, tz="UTC") -> DataFrame:
    """Share of today's trips per mode."""
    t = qo.trips_by_mode(m, now, tz)
    return t.withColumn("share_pct", rha(F.col("trips") * 100.0 / F.sum("trips").over(Window.partitionBy()), 1))


def weather_multiplier(m) -> DataFrame:
    """Delay multiplier and % change of each condition vs 'Clear'."""
    o = qw.overview(m)
    clear = o.filter(F.col("condition") == "Clear").select("avg_delay_minutes").scalar()
    return o.select("condition", "avg_delay_minutes", "trip_count",
                    rha(safe_divide(F.col("avg_delay_minutes"), clear), 2).alias("multiplier"),
                    rha(safe_divide(F.col("avg_delay_minutes") - clear, clear) * 100, 0).alias("pct_vs_clear"))


def route_weather_sensitivity(m) -> DataFrame:
    """adverse/clear delay ratio per route (>4 HIGH, >2.5 MEDIUM)."""
    v = qw.route_vulnerability(m)
    clear = F.coalesce("clear_avg", F.lit(0.0))
    adverse = F.coalesce("snow_avg", "precip_avg", "wind_avg", F.lit(0.0))
    mult = F.when((clear > 0) & (adverse > 0), adverse / clear).otherwise(F.lit(0.0))
    return v.select("route_id", "clear_avg", "snow_avg", "precip_avg", "wind_avg", "total_trips",
                    rha(mult, 2).alias("multiplier"),
                    F.when(mult > 4, "HIGH").when(mult > 2.5, "MEDIUM").otherwise("LOW").alias("sensitivity"))


def weather_vulnerability_ranking(m, n=8) -> DataFrame:
    """Routes ranked by the worst adverse-weather increase over clear."""
    v = qw.route_vulnerability(m)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    inc = F.greatest(z(F.col("snow_avg")), z(F.col("precip_avg")), z(F.col("wind_avg"))) - z(F.col("clear_avg"))
    v = v.withColumn("adverse_increase", rha(inc, 1))
    return v.orderBy(F.col("adverse_increase").desc(), F.col("route_id")).limit(n)


def weekday_weekend_pivot(m, route_filter="all") -> DataFrame:
    """Hourly trip-weighted delay, weekday vs weekend columns."""
    d = qt.hourly(m, route_filter, "all")
    g = d.groupBy("hour", "day_type").agg(
        rha(safe_divide(F.sum(F.col("avg_delay_minutes") * F.col("trip_count")), F.sum("trip_count")), 1).alias("v"))
    return g.groupBy("hour").pivot("day_type", ["weekday", "weekend"]).agg(F.first("v"))


def delay_distribution_by_route(m) -> DataFrame:
    """Share of each delay category per route."""
    r = m.route_reliability
    tot = F.col("total_predictions")
    cats = ["early_count", "on_time_strict_count", "slightly_late_count", "late_count", "very_late_count"]
    return r.select("route_id", "route_name", "total_predictions",
                    *[rha(F.col(c) * 100.0 / tot, 1).alias(c.replace("_count", "_pct")) for c in cats])


def worst_best_routes(m, n=10) -> DataFrame:
    """The n least and n most reliable routes (report)."""
    r = m.route_reliability.select("route_id", "route_name", "route_type_desc", "total_predictions",
                                   "on_time_pct", "avg_delay_seconds", "reliability_score")
    worst = r.orderBy(F.col("reliability_score").asc_nulls_last(), "route_id").limit(n) \
        .withColumn("report", F.lit("worst"))
    best = r.orderBy(F.col("reliability_score").desc_nulls_last(), "route_id").limit(n) \
        .withColumn("report", F.lit("best"))
    return worst.unionByName(best)


def timetable_by_trip(m, route_id, direction_id, start, end, tz="UTC") -> DataFrame:
    """Timetable rows grouped per trip, stops in sequence order."""
    from transitlake.plans.queries import schedules as qs
    t = qs.timetable(m, route_id, direction_id, start, end, tz, limit=None)
    return t.groupBy("trip_id", "service_date").agg(
        F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "stop_name",
                                             "departure_time"))).alias("stops"),
        F.min("departure_time").alias("first_departure"))


def active_alert_severity_share(m, now) -> DataFrame:
    """Share of active alerts per severity class."""
    a = qa.alerts_active(m, now, "all", None)
    g = a.groupBy("severity_category").agg(F.count(F.lit(1)).alias("alerts"))
    return g.withColumn("share_pct", rha(F.col("alerts") * 100.0 / F.sum("alerts").over(Window.partitionBy()), 1))


def alert_effect_severity(m) -> DataFrame:
    """Alert counts and mean impact by effect × severity class."""
    return m.alert_summary.groupBy("effect", "severity_category").agg(
        F.count(F.lit(1)).alias("alerts"), rha(avg_fixed("impact_score", 2), 2).alias("avg_impact"))


def network_summary(m) -> DataFrame:
    """Routes, subway routes, bus routes, stops, stations, municipalities."""
    r = m.raw.routes.agg(F.count(F.lit(1)).alias("routes"),
                         F.count_if(F.col("route_type").isin(0, 1)).alias("subway_routes"),
                         F.count_if(F.col("route_type") == 3).alias("bus_routes"))
    s = m.raw.stops.agg(F.count(F.lit(1)).alias("stops"),
                        F.count_if(F.col("location_type") == 1).alias("stations"),
                        F.countDistinct("municipality").alias("municipalities"))
    return r.select("*", *[s.select(c).scalar().alias(c) for c in ("stops", "stations", "municipalities")])


def station_network(m) -> DataFrame:
    """Stops rolled up to their station (parent, else themselves)."""
    s = m.raw.stops.select("stop_id", "name", "parent_station_id", "municipality")
    p = s.select(F.col("stop_id").alias("pid"), F.col("name").alias("parent_name"))
    j = s.join(p, s.parent_station_id == p.pid, "left")
    return (j.groupBy(F.coalesce("parent_station_id", "stop_id").alias("station_id"))
            .agg(F.min(F.coalesce("parent_name", "name")).alias("station_name"),
                 F.count(F.lit(1)).alias("stops"), F.countDistinct("municipality").alias("municipalities")))


def data_coverage(m) -> DataFrame:
    """Rows, rows with delay, routes, stops, earliest, latest, hours."""
    e = m.scheduled_vs_actual
    return e.agg(F.count(F.lit(1)).alias("rows"), F.count("delay_seconds").alias("with_delay"),
                 F.countDistinct("route_id").alias("routes"), F.countDistinct("stop_id").alias("stops"),
                 F.min("extracted_at").alias("earliest"), F.max("extracted_at").alias("latest"),
                 F.countDistinct(F.date_trunc("hour", "extracted_at")).alias("hours_collected"))


def delay_distribution_summary(m, lo=-600, hi=1200) -> DataFrame:
    """Summary statistics of delays clipped to [lo, hi] seconds."""
    d = F.least(F.greatest(F.col("delay_seconds"), F.lit(lo)), F.lit(hi))
    e = m.scheduled_vs_actual.filter(F.col("delay_seconds").isNotNull())
    q = F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = e.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), q.alias("q"),
              F.stddev(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max"))
    return a.select("n", rha("mean", 2).alias("mean"), rha(F.col("q")[0], 2).alias("p25"),
                    rha(F.col("q")[1], 2).alias("median"), rha(F.col("q")[2], 2).alias("p75"),
                    rha("std", 2).alias("std"), "min", "max")


def delay_category_shares(m) -> DataFrame:
    """Share of observations per delay category."""
    g = m.scheduled_vs_actual.groupBy("delay_category").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", rha(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def late_rate_by_weather(m) -> DataFrame:
    """Late rate (> 60 s) per weather condition."""
    w = m.weather_transit.filter(F.col("weather_condition").isNotNull())
    return w.groupBy("weather_condition").agg(
        F.count(F.lit(1)).alias("n"),
        rha(F.avg(F.when(F.col("delay_seconds") > 60, 1.0).otherwise(0.0)) * 100, 2).alias("late_pct"))


def mart_health(m) -> DataFrame:
    """All marts non-empty and their total rows."""
    q = qo.quality_overview(m)
    return q.agg(F.min(F.col("row_count") > 0).alias("all_marts_populated"),
                 F.sum("row_count").alias("total_rows"))


# Rider-message intent tagging -----------------------------------------
# Mode keywords (first match wins, in this order) and the
# trip-request pattern.
MODE_KEYWORDS = [("bus", "Bus"), ("subway", "Heavy Rail"), ("red line", "Red"),
                 ("orange line", "Orange"), ("blue line", "Blue"), ("green line", "Green"),
                 ("commuter rail", "Commuter Rail"), ("ferry", "Ferry")]
TRIP_PATTERN = (r"(?i)\bfrom\s+(.+?)\s+to\s+(.+?)(?:\s+(?:right now|now|today|tonight|this morning|"
                r"this afternoon|this evening)|[?.!,]|$)")
WEATHER_TERMS = ["weather", "rain", "snow", "wind", "temperature"]
DELAY_TERMS = ["delay", "hotspot", "worst", "slowest"]
ALERT_TERMS = ["alert", "running normally", "detour", "service issue"]


def message_intents(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Intent, mode keyword and trip endpoints of each message (whole text)."""
    t = F.col(text_col)
    low = F.lower(t)
    mode = None
    for phrase, value in MODE_KEYWORDS:
        cond = low.contains(phrase)
        mode = F.when(cond, F.lit(value)) if mode is None else mode.when(cond, F.lit(value))
    o = F.nullif(F.trim(F.regexp_extract(t, TRIP_PATTERN, 1)), F.lit(""))
    d = F.nullif(F.trim(F.regexp_extract(t, TRIP_PATTERN, 2)), F.lit(""))
    any_of = lambda terms: F.exists(F.array(*[F.lit(x) for x in terms]), lambda x: low.contains(x))
    intent = (F.when(o.isNotNull() & d.isNotNull(), F.lit("trip"))
              .when(any_of(WEATHER_TERMS), F.lit("weather"))
              .when(any_of(DELAY_TERMS), F.lit("delays"))
              .when(mode.isNotNull() | any_of(ALERT_TERMS), F.lit("alerts"))
              .otherwise(F.lit("overview")))
    return messages.select("*", intent.alias("intent"), mode.alias("route_or_mode"),
                           o.alias("origin_text"), d.alias("destination_text"))


# Trip options ----------------------------------------------------------
def trip_options(m, origin, dest, now, limit=10) -> DataFrame:
    """Route options with combined reliability and matching active alerts.

    First-wins per (first, second) route pair in route-finding order;
    two-leg reliability = min on-time, summed delay, max risk, with the
    defaults 70 / 2 / 10 for a route without data; alerts match by route
    id membership (not substring).
    """
    routes = qtr.find_routes(m, origin, dest, limit=None)
    order = [F.col("transfers").asc(), F.col("matching_trips").desc(),
             F.col("first_route_type").asc_nulls_first(), F.col("first_route_id").asc_nulls_first(),
             F.col("second_route_id").asc_nulls_first(), F.col("transfer_stop_id").asc_nulls_first()]
    w = Window.partitionBy("first_route_id", F.coalesce("second_route_id", F.lit(""))).orderBy(*order)
    r = routes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    ids = r.select(F.col("first_route_id").alias("route_id")).unionByName(
        r.select(F.col("second_route_id").alias("route_id"))).filter(F.col("route_id").isNotNull())
    rel = qtr.route_reliability_for(m, ids)
    r1 = rel.select(F.col("route_id").alias("first_route_id"), F.col("on_time_pct").alias("ot1"),
                    F.col("avg_delay_minutes").alias("dl1"), F.col("delay_risk_pct").alias("rk1"))
    r2 = rel.select(F.col("route_id").alias("second_route_id"), F.col("on_time_pct").alias("ot2"),
                    F.col("avg_delay_minutes").alias("dl2"), F.col("delay_risk_pct").alias("rk2"))
    j = r.join(r1, "first_route_id", "left").join(r2, "second_route_id", "left")
    ot1, dl1, rk1 = (F.coalesce(F.col(c), F.lit(v)) for c, v in
                     (("ot1", DEFAULT_ON_TIME), ("dl1", DEFAULT_DELAY_MIN), ("rk1", DEFAULT_RISK)))
    ot2, dl2, rk2 = (F.coalesce(F.col(c), F.lit(v)) for c, v in
                     (("ot2", DEFAULT_ON_TIME), ("dl2", DEFAULT_DELAY_MIN), ("rk2", DEFAULT_RISK)))
    two = F.col("second_route_id").isNotNull()
    j = j.select("*", F.when(two, F.least(ot1, ot2)).otherwise(ot1).alias("on_time_pct"),
                 rha(F.when(two, dl1 + dl2).otherwise(dl1), 1).alias("avg_delay_minutes"),
                 F.when(two, F.greatest(rk1, rk2)).otherwise(rk1).alias("delay_risk_pct"))
    alerts = qa.alerts_active(m, now, "all", None).select(
        "alert_id", F.explode("affected_routes").alias("route_id")).distinct()
    opt_routes = j.select("first_route_id", "second_route_id",
                          F.explode(F.array_compact(F.array("first_route_id", "second_route_id"))).alias("route_id"))
    cnt = (opt_routes.join(alerts, "route_id").groupBy("first_route_id", "second_route_id")
           .agg(F.countDistinct("alert_id").alias("active_alerts")))
    j = j.join(cnt, [j.first_route_id.eqNullSafe(cnt.first_route_id),
                     j.second_route_id.eqNullSafe(cnt.second_route_id)], "left") \
        .drop(cnt.first_route_id).drop(cnt.second_route_id)
    out = j.select("connection_type", "transfers", "first_route_id", "first_route_name", "second_route_id",
                   "second_route_name", "transfer_stop_id", "transfer_stop_name", "on_time_pct",
                   "avg_delay_minutes", "delay_risk_pct", reliability_label("on_time_pct").alias("label"),
                   F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"))
    return out.orderBy(F.col("transfers"), F.col("on_time_pct").desc(), F.col("first_route_id"),
                       F.col("second_route_id").asc_nulls_first()).limit(limit)


def delay_probability_risk(m, route_filter="all") -> DataFrame:
    """Risk level per hour from the delay-probability query."""
    return qt.delay_probability(m, route_filter).withColumn("risk_level", risk_level("delay_probability"))
