"""The jobs that fit random forests, over a frame that only a forest learns."""

import tempfile

import pytest
from pyspark.sql import functions as F

from transitlake.plans import catalog_ml as C
from transitlake.plans import features as FE
from transitlake.plans import learning as L
from transitlake.plans import registry


@pytest.fixture()
def frame(spark, monkeypatch):
    """600 rows, late from 8 to 11 and from 18 to 21: no linear function of the hour."""
    hour = (F.col("id") % 24).cast("int")
    late = hour.between(8, 11) | hour.between(18, 21)
    given = {c: hour for c in FE.NUMERIC_FEATURES if not c.endswith("_i")}
    given |= {c: F.lit(False) for c in ("is_precipitation", "is_snow")}
    df = spark.range(0, 600, 1, 4).select(
        F.col("id").alias("prediction_id"), F.col("id").alias("trip_id"), F.col("id").alias("extracted_at"),
        (F.col("id") % 3).alias("route_id"), (F.col("id") % 7).alias("stop_id"), *[v.alias(k) for k, v in given.items()],
        F.when(late, 300).otherwise(0).alias("target_delay_seconds"), late.cast("int").alias("target_is_late"))
    monkeypatch.setattr(FE, "feature_matrix", lambda m: df)
    monkeypatch.setattr(L, "RF_TREES", 5)
    return df


def test_comparisons_hold_the_forests_and_the_best_model_is_one(frame):
    reg = {r["model"]: r["r2"] for r in C.regression_comparison(None).collect()}
    assert set(reg) == {"mean_baseline", "linear", "ridge_1", "ridge_10", "random_forest"}
    assert reg["random_forest"] > reg["linear"] + 0.3, reg
    assert registry._MODEL_FNS["r16_best_regression_model"](None).first()["best_model"] == "random_forest"
    cls = {r["model"]: r["f1"] for r in C.classification_comparison(None).collect()}
    assert set(cls) == {"majority", "logistic", "random_forest"} and cls["random_forest"] > cls["logistic"], cls


def test_cross_validation_scores_every_model(frame):
    rows = C.cross_validation(None).collect()
    assert sorted((r["model"], r["fold"], r["metric"]) for r in rows) == sorted(
        (name, k, metric) for k in range(5)
        for name, metric in (("ridge_1", "mae"), ("random_forest_regressor", "mae"), ("random_forest_classifier", "f1")))


def test_breakdowns_evaluate_the_forests(frame):
    job = registry._MODEL_FNS
    assert job["r22_precision_recall_summary"](None).first()["best_f1"] > 0.9
    assert all(r["mae"] < 60 for r in job["r23b_error_by_delay_bucket"](None).collect())


def test_sample_bounds_only_the_classifiers_trees(frame):
    data = L.split(frame).cache()
    n = data.filter("NOT is_test").count()
    model, _ = L.fit_forest(data, L.regression_models(1)["random_forest"], rows=20)
    assert sum(t.numNodes for t in model.stages[-1].trees) > L.RF_TREES * 3  # 20 rows make one split a tree at most
    everything = data.withColumn("stop_id", F.col("prediction_id"))
    model, _ = L.fit_forest(everything, L.classification_models()["random_forest"], rows=50)
    assert len(model.stages[1].labels) == n
    assert "scaler" not in str(model.stages).lower()


def test_one_fit_serves_every_evaluation(frame, spark, monkeypatch):
    from transitlake.plans import fits
    store = fits.FitStore(spark, tempfile.mkdtemp(prefix="fits-"))
    calls = []
    real = L.fit_forest
    monkeypatch.setattr(L, "fit_forest", lambda *a, **k: calls.append(1) or real(*a, **k))
    data, est = L.split(frame), L.regression_models(1)["random_forest"]
    one, two = store.fit(data, est), store.fit(data.repartition(7), est)
    assert one.fresh and not two.fresh and one.path == two.path and len(calls) == 1
    assert one.predictions.count() == data.filter("is_test").count() and "features" not in one.predictions.columns
    again = one.model.transform(data.filter("is_test")).select("prediction_id", "prediction")
    assert again.exceptAll(two.predictions.select("prediction_id", "prediction")).count() == 0
    assert abs(sum(r["importance"] for r in two.importances.collect()) - 1) < 1e-6
    # Other rows or other settings are other fits.
    assert store.fit(data.filter("prediction_id < 500"), est).fresh
    assert store.fit(data, est.copy().setNumTrees(3)).fresh and len(calls) == 3


def test_curves_and_reports_of_the_best_classifier(frame):
    job = registry._MODEL_FNS
    assert {r["model"] for r in job["r17_roc_curve"](None).select("model").distinct().collect()} == {"logistic", "random_forest"}
    for key in ("r17b_confusion_matrix", "r17f_best_class_report"):
        assert {r["model"] for r in job[key](None).collect()} == {"random_forest"}, key
    assert job["r16b_residual_statistics"](None).first()["model"] == "random_forest"
    assert job["r22b_precision_recall_curve"](None).agg(F.max("recall")).first()[0] == 1.0


def test_sample_of_very_many_rows_is_not_empty(frame):
    class Many:
        def count(self):
            return 5_000_000_000

        def filter(self, cond):
            return cond

    assert str(4000 * 2**64 // 5_000_000_000 - 2**63) in str(L.forest_sample(Many(), rows=4000))
    assert 100 < L.forest_sample(frame, rows=200).count() < 300


def test_scores_are_those_of_the_models_own_transform(frame):
    from transitlake.plans import forests
    data = L.split(frame.withColumn("uncertainty", F.pmod(F.xxhash64("prediction_id"), F.lit(97)) / 7.0)
                   .withColumn("target_is_late", F.pmod(F.xxhash64("prediction_id"), F.lit(3)).cast("int") % 2)).cache()
    for estimator, scores in ((L.classification_models()["random_forest"], ["prediction", "probability_late"]),
                              (L.regression_models(1)["random_forest"], ["prediction"])):
        model, pred = L.fit_forest(data, estimator)
        assert "features" not in pred.columns and "probability" not in pred.columns
        want = L.late_probability(model.transform(data.filter("is_test"))).select("prediction_id", *scores)
        assert want.exceptAll(pred.select("prediction_id", *scores)).count() == 0
        assert pred.count() == want.count() > 50
    assert max(t[0] for t in forests.trees(data.sparkSession, model.stages[-1])) > 2
