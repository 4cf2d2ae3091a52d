"""Registration of the derived analytics (O1–O21) with their oracles."""

from __future__ import annotations

from transitlake.plans import derived as O
from transitlake.plans.catalog_queries import (
    DEST, END, NOW_ALERTS, NOW_SERVICE, ORIGIN, ROUTE, START, _MART_MEAS, sdiv,
)
from transitlake.plans.oracle_sql import avg_fixed as avgf, rnd
from transitlake.plans.registry import final_sql as fs
from transitlake.plans.registry import register
from transitlake.sources.proxy import RawTables

register("o01_heatmap_anomalies", f"""
SELECT *, avg_delay_minutes > 2.0::DOUBLE * avg(avg_delay_minutes) OVER (PARTITION BY hour) AS is_anomaly
FROM ({fs('n07_heatmap_day_hour')}) c""")(lambda m: O.heatmap_anomalies(m))

register("o01b_heatmap_summary", f"""
WITH c AS ({fs('n07_heatmap_day_hour')})
SELECT w.day_of_week AS worst_day, w.hour AS worst_hour, w.avg_delay_minutes AS worst_avg_delay_minutes,
  b.day_of_week AS best_day, b.hour AS best_hour, b.avg_delay_minutes AS best_avg_delay_minutes, t.total_trips
FROM (SELECT * FROM c ORDER BY avg_delay_minutes DESC, day_num, hour LIMIT 1) w,
     (SELECT * FROM c ORDER BY avg_delay_minutes, day_num, hour LIMIT 1) b,
     (SELECT CAST(sum(trip_count) AS BIGINT) AS total_trips FROM c) t""")(lambda m: O.heatmap_summary(m))

register("o02_weekday_insight", f"""
WITH d AS ({fs('n32_temporal_day_of_week')}),
s AS (SELECT sum(avg_delay_minutes * trip_count) / sum(trip_count) AS sa FROM d)
SELECT w.day_of_week AS worst_day, w.avg_delay_minutes AS worst_avg_delay_minutes,
  b.day_of_week AS best_day, b.avg_delay_minutes AS best_avg_delay_minutes,
  {rnd('s.sa', 3)} AS system_avg_minutes,
  {rnd('CASE WHEN s.sa <> 0 THEN (w.avg_delay_minutes - s.sa) / s.sa * 100 ELSE 0.0 END', 0)} AS worst_pct_above
FROM (SELECT * FROM d ORDER BY avg_delay_minutes DESC, day_num LIMIT 1) w,
     (SELECT * FROM d ORDER BY avg_delay_minutes, day_num LIMIT 1) b, s""")(lambda m: O.weekday_insight(m))

register("o03_overview_deltas", f"""
WITH cur AS ({fs('n15_overview_system_enhanced')}), prev AS ({fs('n16_overview_system_previous_day')}),
x AS (SELECT cur.*, coalesce(prev.on_time_pct, cur.on_time_pct) AS pot,
        coalesce(prev.avg_delay_minutes, cur.avg_delay_minutes) AS pdl,
        coalesce(prev.total_trips, cur.total_trips) AS ptr,
        coalesce(prev.active_alerts, cur.active_alerts) AS pal FROM cur, prev)
SELECT total_trips, on_time_pct, avg_delay_minutes, active_alerts, critical_alerts, major_alerts,
  minor_alerts, info_alerts, {rnd('on_time_pct - pot', 1)} AS on_time_pct_change,
  {rnd('avg_delay_minutes - pdl', 1)} AS avg_delay_change, total_trips - ptr AS total_trips_change,
  {rnd('CASE WHEN ptr > 0 THEN (total_trips - ptr) / ptr * 100 ELSE 0.0 END', 1)} AS trips_change_pct,
  active_alerts - pal AS active_alerts_change
FROM x""")(lambda m: O.overview_deltas(m, NOW_SERVICE))

register("o05_mode_health", f"""
SELECT *, CASE WHEN on_time_pct >= 85 THEN 'Good' WHEN on_time_pct >= 70 THEN 'Fair' ELSE 'Poor' END AS health
FROM (SELECT route_type_desc AS mode, CAST(sum(total_predictions) AS BIGINT) AS observations,
  {rnd(sdiv('sum(on_time_pct * total_predictions)', 'sum(total_predictions)'), 1)} AS on_time_pct,
  {rnd(sdiv('sum(avg_delay_seconds * total_predictions)', 'sum(total_predictions)') + ' / 60.0::DOUBLE', 1)} AS avg_delay_minutes,
  count(*) AS routes
FROM mart_route_reliability GROUP BY route_type_desc) g""")(O.mode_health)

register("o06_performance_pivot", f"""
WITH t AS ({fs('n10_overview_performance_trends')})
SELECT hour_of_day,
  max(CASE WHEN mode = 'Light Rail' THEN on_time_pct END) AS light_rail,
  max(CASE WHEN mode = 'Heavy Rail' THEN on_time_pct END) AS heavy_rail,
  max(CASE WHEN mode = 'Commuter Rail' THEN on_time_pct END) AS commuter_rail,
  max(CASE WHEN mode = 'Bus' THEN on_time_pct END) AS bus,
  max(CASE WHEN mode = 'Ferry' THEN on_time_pct END) AS ferry,
  {rnd(sdiv('sum(on_time_pct * trips)', 'sum(trips)'), 1)} AS all_modes
FROM t GROUP BY hour_of_day""")(lambda m: O.performance_pivot(m))

register("o07_mode_share", f"""
WITH t AS ({fs('n17_overview_trips_by_mode')})
SELECT *, {rnd('trips * 100.0::DOUBLE / sum(trips) OVER ()', 1)} AS share_pct FROM t""")(
    lambda m: O.mode_share(m, NOW_SERVICE))

register("o08_weather_multiplier", f"""
WITH o AS ({fs('n43_weather_overview')}), c AS (SELECT (SELECT avg_delay_minutes FROM o WHERE condition = 'Clear') AS clear)
SELECT condition, avg_delay_minutes, trip_count, {rnd(sdiv('avg_delay_minutes', 'c.clear'), 2)} AS multiplier,
  {rnd(sdiv('avg_delay_minutes - c.clear', 'c.clear') + ' * 100', 0)} AS pct_vs_clear
FROM o, c""")(O.weather_multiplier)

_MULT = ("CASE WHEN coalesce(clear_avg, 0.0) > 0 AND coalesce(snow_avg, precip_avg, wind_avg, 0.0) > 0 "
         "THEN coalesce(snow_avg, precip_avg, wind_avg, 0.0) / coalesce(clear_avg, 0.0) ELSE 0.0 END")
register("o09_route_weather_sensitivity", f"""
SELECT route_id, clear_avg, snow_avg, precip_avg, wind_avg, total_trips, {rnd(_MULT, 2)} AS multiplier,
  CASE WHEN {_MULT} > 4 THEN 'HIGH' WHEN {_MULT} > 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS sensitivity
FROM ({fs('n44_weather_route_vulnerability')}) v""")(O.route_weather_sensitivity)

_INC = ("greatest(coalesce(snow_avg, 0.0), coalesce(precip_avg, 0.0), coalesce(wind_avg, 0.0)) "
        "- coalesce(clear_avg, 0.0)")
register("o09b_weather_vulnerability_ranking", f"""
SELECT *, {rnd(_INC, 1)} AS adverse_increase FROM ({fs('n44_weather_route_vulnerability')}) v
ORDER BY adverse_increase DESC, route_id LIMIT 8""")(lambda m: O.weather_vulnerability_ranking(m))

register("o10_weekday_weekend_pivot", f"""
WITH d AS (SELECT hour_of_day AS hour, day_type, time_period, {_MART_MEAS}
           FROM mart_delay_analysis GROUP BY hour_of_day, day_type, time_period),
g AS (SELECT hour, day_type, {rnd(sdiv('sum(avg_delay_minutes * trip_count)', 'sum(trip_count)'), 1)} AS v
      FROM d GROUP BY hour, day_type)
SELECT hour, max(CASE WHEN day_type = 'weekday' THEN v END) AS weekday,
  max(CASE WHEN day_type = 'weekend' THEN v END) AS weekend FROM g GROUP BY hour""")(
    lambda m: O.weekday_weekend_pivot(m))

register("o11_delay_distribution_by_route", f"""
SELECT route_id, route_name, total_predictions,
  {rnd('early_count * 100.0::DOUBLE / total_predictions', 1)} AS early_pct,
  {rnd('on_time_strict_count * 100.0::DOUBLE / total_predictions', 1)} AS on_time_strict_pct,
  {rnd('slightly_late_count * 100.0::DOUBLE / total_predictions', 1)} AS slightly_late_pct,
  {rnd('late_count * 100.0::DOUBLE / total_predictions', 1)} AS late_pct,
  {rnd('very_late_count * 100.0::DOUBLE / total_predictions', 1)} AS very_late_pct
FROM mart_route_reliability""")(O.delay_distribution_by_route)

_RR = "route_id, route_name, route_type_desc, total_predictions, on_time_pct, avg_delay_seconds, reliability_score"
register("o12_worst_best_routes", f"""
(SELECT {_RR}, 'worst' AS report FROM mart_route_reliability ORDER BY reliability_score ASC NULLS LAST, route_id LIMIT 10)
UNION ALL
(SELECT {_RR}, 'best' AS report FROM mart_route_reliability ORDER BY reliability_score DESC NULLS LAST, route_id LIMIT 10)""")(
    lambda m: O.worst_best_routes(m))

register("o13_timetable_by_trip", f"""
SELECT trip_id, service_date,
  list({{'stop_sequence': stop_sequence, 'stop_id': stop_id, 'stop_name': stop_name, 'departure_time': departure_time}}
       ORDER BY stop_sequence, stop_id, stop_name, departure_time) AS stops,
  min(departure_time) AS first_departure
FROM ({fs('n26_schedules_timetable').replace("LIMIT 1000", "")}) t GROUP BY trip_id, service_date""")(
    lambda m: O.timetable_by_trip(m, ROUTE, 0, START, END))

_N1_ALL = fs("n01_alerts_active").replace("LIMIT 50", "")
register("o14_active_alert_severity_share", f"""
WITH a AS ({_N1_ALL}), g AS (SELECT severity_category, count(*) AS alerts FROM a GROUP BY severity_category)
SELECT *, {rnd('alerts * 100.0::DOUBLE / sum(alerts) OVER ()', 1)} AS share_pct FROM g""")(
    lambda m: O.active_alert_severity_share(m, NOW_ALERTS))

register("o14b_alert_effect_severity", f"""
SELECT effect, severity_category, count(*) AS alerts, {rnd(avgf('impact_score', 2), 2)} AS avg_impact
FROM mart_alert_summary GROUP BY effect, severity_category""")(O.alert_effect_severity)

register("o15_network_summary", """
SELECT count(*) AS routes, count(CASE WHEN route_type IN (0, 1) THEN 1 END) AS subway_routes,
  count(CASE WHEN route_type = 3 THEN 1 END) AS bus_routes,
  (SELECT count(*) FROM raw_stops) AS stops,
  (SELECT count(CASE WHEN location_type = 1 THEN 1 END) FROM raw_stops) AS stations,
  (SELECT count(DISTINCT municipality) FROM raw_stops) AS municipalities
FROM raw_routes""")(O.network_summary)

register("o16_station_network", """
SELECT coalesce(s.parent_station_id, s.stop_id) AS station_id, min(coalesce(p.name, s.name)) AS station_name,
  count(*) AS stops, count(DISTINCT s.municipality) AS municipalities
FROM raw_stops s LEFT JOIN raw_stops p ON s.parent_station_id = p.stop_id
GROUP BY coalesce(s.parent_station_id, s.stop_id)""")(O.station_network)

register("o17_data_coverage", """
SELECT count(*) AS rows, count(delay_seconds) AS with_delay, count(DISTINCT route_id) AS routes,
  count(DISTINCT stop_id) AS stops, min(extracted_at) AS earliest, max(extracted_at) AS latest,
  count(DISTINCT date_trunc('hour', extracted_at)) AS hours_collected
FROM int_scheduled_vs_actual""")(O.data_coverage)

_CL = "least(greatest(delay_seconds, -600), 1200)"
register("o18_delay_distribution_summary", f"""
SELECT count(*) AS n, {rnd(f'avg({_CL})', 2)} AS mean, {rnd(f'quantile_cont({_CL}, 0.25)', 2)} AS p25,
  {rnd(f'quantile_cont({_CL}, 0.5)', 2)} AS median, {rnd(f'quantile_cont({_CL}, 0.75)', 2)} AS p75,
  {rnd(f'stddev_samp({_CL})', 2)} AS std, min({_CL}) AS min, max({_CL}) AS max
FROM int_scheduled_vs_actual WHERE delay_seconds IS NOT NULL""")(lambda m: O.delay_distribution_summary(m))

register("o18b_delay_category_shares", f"""
SELECT delay_category, count(*) AS n, {rnd('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 2)} AS pct
FROM int_scheduled_vs_actual GROUP BY delay_category""")(O.delay_category_shares)

register("o19_late_rate_by_weather", f"""
SELECT weather_condition, count(*) AS n,
  {rnd('avg(CASE WHEN delay_seconds > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100', 2)} AS late_pct
FROM int_weather_transit WHERE weather_condition IS NOT NULL GROUP BY weather_condition""")(O.late_rate_by_weather)

register("o20_mart_health", f"""
SELECT min(row_count > 0) AS all_marts_populated, CAST(sum(row_count) AS BIGINT) AS total_rows
FROM ({fs('n19_quality_overview')}) q""")(O.mart_health)


def _intent_sql() -> str:
    mode = " ".join(f"WHEN contains(lower(text), '{p}') THEN '{v}'" for p, v in O.MODE_KEYWORDS)
    pat = O.TRIP_PATTERN.replace("'", "''")
    anyof = lambda terms: " OR ".join(f"contains(lower(text), '{t}')" for t in terms)
    return f"""
SELECT message_id, turn, text,
  CASE WHEN o IS NOT NULL AND d IS NOT NULL THEN 'trip' WHEN {anyof(O.WEATHER_TERMS)} THEN 'weather'
       WHEN {anyof(O.DELAY_TERMS)} THEN 'delays' WHEN mode IS NOT NULL OR {anyof(O.ALERT_TERMS)} THEN 'alerts'
       ELSE 'overview' END AS intent,
  mode AS route_or_mode, o AS origin_text, d AS destination_text
FROM (SELECT conv_id AS message_id, turn, text, CASE {mode} END AS mode,
        nullif(trim(regexp_extract(text, '{pat}', 1)), '') AS o,
        nullif(trim(regexp_extract(text, '{pat}', 2)), '') AS d
      FROM conversations WHERE role = 'user') x"""


register("o21_message_intents", _intent_sql())(lambda m: O.message_intents(m.raw.messages))

# Trip options (rows-only: combines route finding, reliability and alerts).
register("o04_trip_options")(lambda m: O.trip_options(m, ORIGIN, DEST, NOW_ALERTS))
register("o13b_delay_probability_risk", f"""
SELECT *, CASE WHEN delay_probability >= 40 THEN 'HIGH' WHEN delay_probability >= 20 THEN 'MEDIUM' ELSE 'LOW' END
  AS risk_level FROM ({fs('n33_temporal_delay_probability')}) d""")(lambda m: O.delay_probability_risk(m))
