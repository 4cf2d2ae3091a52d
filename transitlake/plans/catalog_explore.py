"""Registration of the exploration queries, and of the evaluation formulas
over a prediction frame made by integer arithmetic (so SQL can restate it)."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.functions.core import lit_ts
from transitlake.functions.labels import delay_status
from transitlake.plans import explore as X
from transitlake.plans import learning as L
from transitlake.plans.catalog_queries import NOW_SERVICE
from transitlake.plans.oracle_sql import rnd
from transitlake.plans.registry import register

ALERT_TEXT = "delay"

register("i19_stops_by_municipality", """
SELECT municipality, count(*) AS count FROM raw_stops GROUP BY municipality
ORDER BY count DESC, municipality NULLS FIRST LIMIT 15""")(
    lambda m: X.group_counts(m.raw.stops, "municipality", 15))
register("i19b_stops_by_location_type", """
SELECT location_type_desc, count(*) AS count FROM raw_stops GROUP BY location_type_desc""")(
    lambda m: X.group_counts(m.raw.stops, "location_type_desc"))

register("i20_delay_histogram", f"""
WITH d AS (SELECT delay_seconds::DOUBLE AS x FROM int_scheduled_vs_actual),
r AS (SELECT min(x) AS lo, (max(x) - min(x)) / 80.0::DOUBLE AS step FROM d),
b AS (SELECT CASE WHEN step > 0 THEN least(floor((x - lo) / step), 79) ELSE 0 END::INTEGER AS bin FROM d, r)
SELECT bin, {rnd('lo + step * bin', 4)} AS from_value, count(*) AS count FROM b, r GROUP BY bin, lo, step""")(
    lambda m: X.histogram(m.scheduled_vs_actual, "delay_seconds"))

register("i20b_delay_box_by_route", f"""
SELECT route_id, count(*) AS count, min(delay_seconds) AS min, {rnd('quantile_cont(delay_seconds, 0.25)', 2)} AS q1,
  {rnd('quantile_cont(delay_seconds, 0.5)', 2)} AS median, {rnd('quantile_cont(delay_seconds, 0.75)', 2)} AS q3,
  max(delay_seconds) AS max
FROM int_scheduled_vs_actual WHERE delay_seconds BETWEEN -600 AND 1200 GROUP BY route_id""")(
    lambda m: X.box_stats(m.scheduled_vs_actual, "route_id", "delay_seconds"))

register("j05_route_rank", """
SELECT route_id, route_name, reliability_score,
  row_number() OVER (ORDER BY reliability_score DESC NULLS LAST, route_id)::INTEGER AS rank
FROM mart_route_reliability""")(
    lambda m: X.ranked(m.route_reliability.select("route_id", "route_name", "reliability_score"),
                       F.col("reliability_score").desc_nulls_last(), F.col("route_id")))

register("g14_alert_text_filter", f"""
SELECT alert_id, header, service_effect FROM stg_alerts
WHERE contains(lower(coalesce(header, '')), '{ALERT_TEXT}') OR contains(lower(coalesce(service_effect, '')), '{ALERT_TEXT}')
   OR contains(lower(coalesce(array_to_string(affected_routes, ','), '')), '{ALERT_TEXT}')""")(
    lambda m: X.alert_text_filter(m.stg_alerts, ALERT_TEXT).select("alert_id", "header", "service_effect"))

register("m09_default_window", f"""
WITH w AS (SELECT CAST(TIMESTAMP '{NOW_SERVICE}' - INTERVAL 3 HOUR AS DATE) - 1 AS first),
days AS (SELECT CAST(unnest(generate_series(first, first + 8, INTERVAL 1 DAY)) AS DATE) AS service_date FROM w),
n AS (SELECT CAST(departure_time - INTERVAL 3 HOUR AS DATE) AS service_date, count(*) AS c
      FROM raw_schedules WHERE departure_time IS NOT NULL GROUP BY 1)
SELECT days.service_date, coalesce(n.c, 0) AS stop_visits FROM days LEFT JOIN n USING (service_date)""")(
    lambda m: X.service_days(m, lit_ts(NOW_SERVICE)))

# -- evaluation formulas over integer-made predictions ------------------------
_PRED_SQL = """
p AS (
  SELECT prediction_id, trip_id, stop_id, route_id, CAST(hour(extracted_at) AS INTEGER) AS hour_of_day,
    delay_seconds AS target_delay_seconds, CASE WHEN delay_seconds > 60 THEN 1 ELSE 0 END AS target_is_late,
    (delay_seconds + (delay_seconds * 7919 + stop_sequence * 104729) % 601)::DOUBLE AS guess,
    abs(delay_seconds * 31 + stop_sequence * 17) % 1000 / 1000.0::DOUBLE AS probability_late
  FROM int_scheduled_vs_actual WHERE stop_sequence IS NOT NULL)"""


def made_predictions(m):
    d, s = F.col("delay_seconds").cast("long"), F.col("stop_sequence").cast("long")
    return m.scheduled_vs_actual.filter(s.isNotNull()).select(
        "prediction_id", "trip_id", "stop_id", "route_id", F.hour("extracted_at").alias("hour_of_day"),
        d.alias("target_delay_seconds"), (d > 60).cast("int").alias("target_is_late"),
        (d + (d * 7919 + s * 104729) % 601).cast("double").alias("guess"),
        (F.abs(d * 31 + s * 17) % 1000 / F.lit(1000.0)).alias("probability_late"))


def _regression(m):
    return made_predictions(m).withColumnRenamed("guess", "prediction")


def _classes(m):
    return made_predictions(m).withColumn("prediction", (F.col("probability_late") >= 0.5).cast("double"))


_CLASS_SQL = _PRED_SQL + ", c AS (SELECT *, (probability_late >= 0.5)::INTEGER AS said FROM p)"

register("r15f_regression_formula", f"""
WITH {_PRED_SQL}, e AS (SELECT guess - target_delay_seconds AS e, target_delay_seconds::DOUBLE AS y FROM p)
SELECT count(*) AS n, {rnd('avg(abs(e))', 3)} AS mae, {rnd('sqrt(avg(e * e))', 3)} AS rmse,
  {rnd('1.0::DOUBLE - sum(e * e) / (var_pop(y) * count(*))', 4)} AS r2 FROM e""")(
    lambda m: L.regression_metrics(_regression(m)))

register("r15g_classification_formula", f"""
WITH {_CLASS_SQL}, k AS (SELECT count(*) AS n, count(*) FILTER (target_is_late = 1 AND said = 1) AS tp,
  count(*) FILTER (target_is_late = 0 AND said = 1) AS fp, count(*) FILTER (target_is_late = 1 AND said = 0) AS fn,
  count(*) FILTER (target_is_late = 0 AND said = 0) AS tn FROM c)
SELECT n, tp, fp, fn, tn, {rnd('(tp + tn) / n', 4)} AS accuracy, {rnd('tp / (tp + fp)', 4)} AS precision,
  {rnd('tp / (tp + fn)', 4)} AS recall, {rnd('2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn))', 4)} AS f1
FROM k""")(lambda m: L.classification_metrics(_classes(m)))

register("r17c_class_report", f"""
WITH {_CLASS_SQL}, k AS (
  SELECT v AS class, count(*) FILTER (target_is_late = v AND said = v) AS hit, count(*) FILTER (said = v) AS said,
    count(*) FILTER (target_is_late = v) AS support FROM c, (SELECT unnest([0, 1]) AS v) GROUP BY v)
SELECT class, {rnd('hit / said', 4)} AS precision, {rnd('hit / support', 4)} AS recall,
  {rnd('2 * (hit / said) * (hit / support) / (hit / said + hit / support)', 4)} AS f1, support FROM k""")(
    lambda m: X.class_report(_classes(m)))

register("r17d_confusion_formula", f"""
WITH {_CLASS_SQL} SELECT target_is_late AS actual, said AS predicted, count(*) AS count FROM c GROUP BY ALL""")(
    lambda m: L.confusion_matrix(_classes(m)))

register("r17e_roc_formula", f"""
WITH {_PRED_SQL}, t AS (SELECT probability_late AS threshold, sum(target_is_late)::BIGINT AS pos,
  sum(1 - target_is_late)::BIGINT AS neg FROM p GROUP BY 1)
SELECT threshold, sum(pos) OVER w / sum(pos) OVER () AS tpr, sum(neg) OVER w / sum(neg) OVER () AS fpr
FROM t WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")(lambda m: L.roc_curve(made_predictions(m)))

register("r20f_error_by_route_formula", f"""
WITH {_PRED_SQL}, e AS (SELECT *, abs(guess - target_delay_seconds) AS e FROM p)
SELECT e.route_id, r.long_name AS route_name, count(*) AS n, {rnd('avg(e)', 2)} AS mae,
  {rnd('avg(target_delay_seconds)', 2)} AS mean_actual, {rnd('avg(guess)', 2)} AS mean_predicted
FROM e LEFT JOIN raw_routes r ON r.route_id = e.route_id GROUP BY e.route_id, r.long_name""")(
    lambda m: X.with_route_names(L.error_by_route(_regression(m)).drop("median_ae"), m.raw.routes))

register("r21f_classification_by_hour_formula", f"""
WITH {_CLASS_SQL}
SELECT hour_of_day, count(*) AS n, {rnd('avg((target_is_late = said)::INTEGER::DOUBLE)', 4)} AS accuracy,
  {rnd('count(*) FILTER (target_is_late = 1 AND said = 1) / nullif(count(*) FILTER (said = 1), 0)', 4)} AS precision,
  {rnd('count(*) FILTER (target_is_late = 1 AND said = 1) / nullif(count(*) FILTER (target_is_late = 1), 0)', 4)} AS recall
FROM c GROUP BY hour_of_day""")(lambda m: L.classification_by(_classes(m), "hour_of_day"))

# The median is the middle order statistic (the lower of two), as a sketch gives it for fewer rows than its accuracy.
register("r16f_residual_formula", f"""
WITH {_PRED_SQL}, e AS (SELECT guess - target_delay_seconds AS e FROM p)
SELECT {rnd('avg(e)', 3)} AS mean_residual, {rnd('stddev_samp(e)', 3)} AS std_residual,
  {rnd('quantile_disc(e, 0.5)', 3)} AS median_residual, {rnd('min(e)', 3)} AS min_residual,
  {rnd('max(e)', 3)} AS max_residual FROM e""")(lambda m: L.residual_stats(_regression(m)))

register("r22f_pr_curve_formula", f"""
WITH {_PRED_SQL}, t AS (SELECT probability_late AS threshold, sum(target_is_late) AS pos, count(*) AS n FROM p GROUP BY 1),
r AS (SELECT threshold, sum(pos) OVER w / sum(n) OVER w AS precision, sum(pos) OVER w / sum(pos) OVER () AS recall
      FROM t WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1
FROM r""")(lambda m: L.pr_curve(made_predictions(m)))

register("m14_delay_status", f"""
WITH a AS (SELECT route_id, avg_delay_seconds / 60.0::DOUBLE AS m FROM mart_route_reliability)
SELECT route_id, CASE WHEN abs(m) < 0.05 THEN '0.0 min on time' ELSE
  CAST(CAST({rnd('abs(m)', 1)} AS DECIMAL(18,1)) AS VARCHAR) || CASE WHEN m < 0 THEN ' min early' ELSE ' min delayed' END
  END AS status FROM a""")(
    lambda m: m.route_reliability.select("route_id", delay_status(F.col("avg_delay_seconds") / 60.0).alias("status")))
