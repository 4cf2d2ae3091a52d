"""Registration of features (R1–R8, with oracles) and model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from transitlake.plans import features as FE
from transitlake.plans import explore as X
from transitlake.plans import learning as L
from transitlake.plans.fits import FitStore, fingerprint
from transitlake.plans.oracle_sql import rnd
from transitlake.plans.registry import register
from transitlake.session import cut_lineage

_LR = "avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"

register("r02_route_history", f"""
SELECT route_id, count(*) AS route_total_obs, {rnd('avg(delay_seconds)', 2)} AS route_avg_delay,
  {rnd('quantile_cont(delay_seconds, 0.5)', 2)} AS route_median_delay,
  {rnd('stddev_samp(delay_seconds)', 2)} AS route_stddev_delay,
  {rnd(_LR.format(c='is_late'), 4)} AS route_late_rate,
  {rnd(_LR.format(c='is_significantly_late'), 4)} AS route_sig_late_rate,
  {rnd('quantile_cont(delay_seconds, 0.9)', 2)} AS route_p90_delay
FROM int_scheduled_vs_actual WHERE delay_seconds IS NOT NULL GROUP BY route_id""")(FE.route_history)

register("r03_stop_history", f"""
SELECT stop_id, count(*) AS stop_total_obs, {rnd('avg(delay_seconds)', 2)} AS stop_avg_delay,
  {rnd('median(delay_seconds)', 2)} AS stop_median_delay, {rnd('stddev_samp(delay_seconds)', 2)} AS stop_stddev_delay,
  {rnd(_LR.format(c='is_late'), 4)} AS stop_late_rate
FROM int_scheduled_vs_actual WHERE delay_seconds IS NOT NULL GROUP BY stop_id""")(FE.stop_history)

register("r04_weather_features", """
SELECT prediction_id, trip_id, stop_id, prediction_hour, temperature_f, humidity_pct, precipitation_mm,
  rain_mm, snowfall_cm, wind_speed_mph, wind_gusts_mph, visibility_m, weather_code, weather_condition,
  is_precipitation, is_snow, is_low_visibility, is_high_wind, delay_seconds
FROM int_weather_transit WHERE delay_seconds IS NOT NULL""")(FE.weather_features)

register("r05_alert_features", """
SELECT route_id, count(*) AS active_alerts, max(severity) AS max_alert_severity,
  CAST(sum(informed_entity_count) AS BIGINT) AS total_entities_affected
FROM (SELECT unnest(affected_routes) AS route_id, severity, informed_entity_count
      FROM mart_alert_summary WHERE is_active = TRUE AND affected_routes IS NOT NULL) e
GROUP BY route_id""")(FE.alert_features)

_FM = f"""
fm AS (
  SELECT b.prediction_id, b.trip_id, b.route_id, b.stop_id, b.direction_id, b.stop_sequence, b.extracted_at,
    b.delay_seconds, b.is_late, b.delay_seconds AS target_delay_seconds,
    CASE WHEN b.delay_seconds > 60 THEN 1 ELSE 0 END AS target_is_late,
    CAST(hour(b.extracted_at) AS INTEGER) AS hour_of_day, CAST(dayofweek(b.extracted_at) AS INTEGER) AS day_of_week,
    CASE WHEN dayofweek(b.extracted_at) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour(b.extracted_at) BETWEEN 6 AND 9 THEN 1 ELSE 0 END AS is_morning_rush,
    CASE WHEN hour(b.extracted_at) BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS is_evening_rush,
    b.stop_sequence AS raw_stop_sequence,
    CASE WHEN b.stop_sequence <= 5 THEN 0 WHEN b.stop_sequence <= 15 THEN 1 ELSE 2 END AS stop_position_bin,
    coalesce(b.arrival_uncertainty, b.departure_uncertainty, 0) AS uncertainty,
    coalesce(ra.ra, 0.0) AS route_avg_delay, coalesce(ra.rs, 0.0) AS route_stddev_delay,
    coalesce(ra.rl, 0.0) AS route_late_rate, coalesce(sa.sa, 0.0) AS stop_avg_delay,
    coalesce(sa.ss, 0.0) AS stop_stddev_delay, coalesce(sa.sl, 0.0) AS stop_late_rate,
    coalesce(w.temperature_f, 0.0) AS temperature_f, coalesce(w.precipitation_mm, 0.0) AS precipitation_mm,
    coalesce(w.wind_speed_mph, 0.0) AS wind_speed_mph, coalesce(w.visibility_m, 24140.0) AS visibility_m,
    coalesce(w.precipitation_mm > 0, FALSE) AS is_precipitation, coalesce(w.snowfall_cm > 0, FALSE) AS is_snow
  FROM int_scheduled_vs_actual b
  LEFT JOIN (SELECT route_id, {rnd('avg(delay_seconds)', 6)} AS ra, {rnd('stddev_samp(delay_seconds)', 6)} AS rs,
               {rnd(_LR.format(c='is_late'), 6)} AS rl FROM int_scheduled_vs_actual
             WHERE delay_seconds IS NOT NULL GROUP BY route_id) ra ON b.route_id = ra.route_id
  LEFT JOIN (SELECT stop_id, {rnd('avg(delay_seconds)', 6)} AS sa, {rnd('stddev_samp(delay_seconds)', 6)} AS ss,
               {rnd(_LR.format(c='is_late'), 6)} AS sl FROM int_scheduled_vs_actual
             WHERE delay_seconds IS NOT NULL GROUP BY stop_id) sa ON b.stop_id = sa.stop_id
  LEFT JOIN stg_weather w ON date_trunc('hour', coalesce(b.predicted_arrival, b.predicted_departure)) = w.weather_timestamp
  WHERE b.delay_seconds IS NOT NULL)"""

register("r06_feature_matrix", f"WITH {_FM} SELECT * FROM fm")(FE.feature_matrix)


def _profile_sql() -> str:
    parts = []
    for c in FE.NUMERIC_FEATURES:
        col = {"is_precipitation_i": "CAST(is_precipitation AS INTEGER)", "is_snow_i": "CAST(is_snow AS INTEGER)"}.get(c, c)
        parts.append(f"SELECT '{c}' AS feature, {rnd(f'count(CASE WHEN {col} IS NULL THEN 1 END) * 100.0::DOUBLE / count(*)', 2)} AS null_pct, "
                     f"{rnd(f'CASE WHEN stddev_samp(CAST({col} AS DOUBLE)) * stddev_samp(CAST(target_delay_seconds AS DOUBLE)) = 0 THEN NULL ELSE covar_samp(CAST({col} AS DOUBLE), CAST(target_delay_seconds AS DOUBLE)) / (stddev_samp(CAST({col} AS DOUBLE)) * stddev_samp(CAST(target_delay_seconds AS DOUBLE))) END', 4)} AS corr FROM fm")
    return f"WITH {_FM}\n" + "\nUNION ALL ".join(parts)


register("r07_feature_profile", _profile_sql())(lambda m: FE.feature_profile(FE.feature_matrix(m)))


def _late_sql() -> str:
    parts = []
    for f in ("hour_of_day", "stop_position_bin", "is_weekend", "day_of_week"):
        parts.append(f"SELECT '{f}' AS feature, CAST({f} AS INTEGER) AS value, count(CASE WHEN target_is_late = 1 THEN 1 END) AS late, "
                     f"count(CASE WHEN target_is_late = 0 THEN 1 END) AS on_time, "
                     f"{rnd('count(CASE WHEN target_is_late = 1 THEN 1 END) * 100.0::DOUBLE / count(*)', 2)} AS late_pct "
                     f"FROM fm GROUP BY 2")
    return f"WITH {_FM}\n" + "\nUNION ALL ".join(parts)


register("r08_late_distribution", _late_sql())(lambda m: FE.late_distribution(FE.feature_matrix(m)))


# -- models (rows-only: fitted models are not reproducible in SQL; the formulas have oracles in catalog_explore) --
# The forests have the source's settings (200 trees, depth 15, leaf 10) and take all training rows.
class Evaluation:
    """The training frame of a model graph and its stored fits."""

    def __init__(self, m):
        self.data = L.training_frame(FE.feature_matrix(m))
        self.of = fingerprint(self.data)
        self.store = FitStore(self.data.sparkSession)

    def fit(self, estimator):
        return self.store.fit(self.data, estimator, self.of)

    def regressors(self) -> dict:
        return L.regression_models(self.data.filter(~F.col("is_test")).count())

    def regressor(self, name: str = "random_forest"):
        return self.fit(self.regressors()[name])

    def classifier(self, name: str = "random_forest"):
        return self.fit(L.classification_models()[name])


def regression_comparison(m):
    """Test-set metrics of the mean baseline and each model."""
    e = Evaluation(m)
    out = L.regression_metrics(L.mean_baseline(e.data)).withColumn("model", F.lit("mean_baseline"))
    for name in e.regressors():
        out = out.unionByName(L.regression_metrics(e.regressor(name).predictions).withColumn("model", F.lit(name)))
    return out


def _classifier_metrics(pred):
    return L.classification_metrics(pred).withColumn("auc", L.roc_auc(pred).scalar())


def classification_comparison(m):
    """Accuracy, precision, recall, F1 and AUC per model."""
    e = Evaluation(m)
    base = L.majority_baseline(e.data)
    out = L.classification_metrics(base).withColumn("auc", F.lit(0.5)).withColumn("model", F.lit("majority"))
    for name in L.classification_models():
        out = out.unionByName(_classifier_metrics(e.classifier(name).predictions).withColumn("model", F.lit(name)))
    return out


register("r15_regression_metrics")(regression_comparison)
register("r15b_classification_metrics")(classification_comparison)
register("r13_forest_regression")(lambda m: L.regression_metrics(Evaluation(m).regressor().predictions))
register("r14_forest_classification")(lambda m: _classifier_metrics(Evaluation(m).classifier().predictions))
register("r18_feature_importance")(lambda m: Evaluation(m).regressor().importances)
register("r16_best_regression_model")(lambda m: L.best_model(regression_comparison(m), "r2"))


def cross_validation(m):
    """5-fold CV over every complete feature row (lineage cut once), each fold's fit stored."""
    data = cut_lineage(L.with_folds(FE.feature_matrix(m)))
    store, of = FitStore(data.sparkSession), fingerprint(data.drop("fold"))

    def fit(fold, estimator):
        # The held-out fold is part of the fit's name.
        held = fold.filter("is_test").agg(F.max("fold")).first()[0]
        return store.fit(fold, estimator, f"{of}/fold-{held}").predictions

    return L.cross_validation(data, L.cv_models(True), fit=fit)


register("r19_cross_validation")(cross_validation)


def residuals(m):
    """Residual statistics of the regressor with the best R2."""
    e = Evaluation(m)
    scored = {name: e.regressor(name).predictions for name in e.regressors()}
    table = L.regression_metrics(scored["linear"]).withColumn("model", F.lit("linear"))
    for name in scored:
        if name != "linear":
            table = table.unionByName(L.regression_metrics(scored[name]).withColumn("model", F.lit(name)))
    best = L.best_model(table, "r2").first()["best_model"]
    return L.residual_stats(scored[best]).withColumn("model", F.lit(best))


register("r16b_residual_statistics")(residuals)


def roc_curves(m):
    """The ROC curve of every classifier."""
    e, out = Evaluation(m), None
    for name in L.classification_models():
        curve = L.roc_curve(e.classifier(name).predictions).withColumn("model", F.lit(name))
        out = curve if out is None else out.unionByName(curve)
    return out


def best_classifier(m):
    """Name and predictions of the classifier with the best F1 (ties: name)."""
    e = Evaluation(m)
    scored = {name: e.classifier(name).predictions for name in L.classification_models()}
    f1 = {name: L.classification_metrics(p).first()["f1"] for name, p in scored.items()}
    best = max(f1, key=lambda name: (f1[name], name))
    return best, scored[best]


def _of_best(fn):
    def job(m):
        name, pred = best_classifier(m)
        return fn(pred).withColumn("model", F.lit(name))
    return job


register("r17_roc_curve")(roc_curves)
register("r17b_confusion_matrix")(_of_best(L.confusion_matrix))
register("r17f_best_class_report")(_of_best(X.class_report))


# The evaluation of the source's notebook 05: predictions of the forests on all test rows.
def _forest_reg_pred(m):
    return Evaluation(m).regressor().predictions


def _forest_cls_pred(m):
    return Evaluation(m).classifier().predictions


def route_priority(m):
    """Both forests fitted on one split."""
    e = Evaluation(m)
    return X.with_route_names(L.route_priority(e.regressor().predictions, e.classifier().predictions), m.raw.routes)


register("r20_error_by_route")(lambda m: X.with_route_names(L.error_by_route(_forest_reg_pred(m)), m.raw.routes))
register("r21_classification_by_route")(
    lambda m: X.with_route_names(L.classification_by(_forest_cls_pred(m), "route_id"), m.raw.routes))
register("r21b_classification_by_hour")(lambda m: L.classification_by(_forest_cls_pred(m), "hour_of_day"))
register("r22_precision_recall_summary")(lambda m: L.pr_summary(_forest_cls_pred(m)))
register("r23_error_extremes")(lambda m: L.error_extremes(_forest_reg_pred(m)))
register("r23b_error_by_delay_bucket")(lambda m: L.error_by_delay_bucket(_forest_reg_pred(m)))
register("r24_route_priority")(route_priority)
register("r22b_precision_recall_curve")(lambda m: L.pr_curve(_forest_cls_pred(m)))
