"""Delay-prediction models and their evaluation (R9–R24) with pyspark.ml.

* Split: ``pmod(xxhash64(row key, seed), 100) < 80`` → train (stable under
  any repartitioning; no ``randomSplit`` drift).
* Encoding: ``StringIndexer(stringOrderType='alphabetAsc')`` for route/stop,
  ``VectorAssembler`` + ``StandardScaler(withMean, withStd)``.
* Metrics are plain aggregates over the prediction frame; ROC / PR curves
  use an exact distributed prefix sum (scores aggregated per distinct
  value, range-partitioned by score, per-partition running sums plus the
  partition offsets) — no single-partition global window, no binning.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away as rha
from transitlake.functions.labels import delay_bucket
from transitlake.plans import forests, grow
from transitlake.plans.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, with_numeric_flags
from transitlake.session import stored

SEED = 42
# Buckets of a probability in [0, 1] for running sums over all thresholds.
SCORE_BUCKETS = 4096
TEST_PCT = 20
# Model settings of the source notebooks (fixed values).
RIDGE_ALPHAS = (1.0, 10.0)
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 200, 15, 10
# Node statistics that a task holds at a time, of a forest that pyspark.ml fits.
FOREST_MEMORY_MB = 512


def split(fm: DataFrame, seed: int = SEED, test_pct: int = TEST_PCT) -> DataFrame:
    """Drop rows with missing features; deterministic hash split."""
    fm = with_numeric_flags(fm).dropna(subset=NUMERIC_FEATURES + CATEGORICAL_FEATURES)
    h = F.pmod(F.xxhash64("prediction_id", "trip_id", "stop_id", "extracted_at", F.lit(seed)), F.lit(100))
    return fm.withColumn("is_test", h < test_pct)


def training_frame(fm: DataFrame, seed: int = SEED, test_pct: int = TEST_PCT) -> DataFrame:
    """Split frame with its lineage cut: written once to the session's
    shared checkpoint folder, so every fitting pass (indexers, scaler,
    optimiser iterations, tree levels) reads it instead of recomputing the
    feature plan, and a lost executor re-reads it rather than the sources."""
    return stored(split(fm, seed, test_pct))


def _prep_stages(scale: bool = True):
    """Codes for route and stop, one vector; scaled for linear models. Trees take
    the unscaled values and the codes as plain numbers, as the source does (a
    code's label metadata would make it a category with a bin for every stop)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in CATEGORICAL_FEATURES]
    if scale:
        asm = VectorAssembler(inputCols=NUMERIC_FEATURES + [f"{c}_idx" for c in CATEGORICAL_FEATURES],
                              outputCol="raw_features", handleInvalid="keep")
        return idx + [asm, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    codes = ", ".join(f"{c}_idx + 0 AS {c}_code" for c in CATEGORICAL_FEATURES)
    asm = VectorAssembler(inputCols=NUMERIC_FEATURES + [f"{c}_code" for c in CATEGORICAL_FEATURES],
                          outputCol="features", handleInvalid="keep")
    return idx + [SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__"), asm]


def regression_models(n_train: int) -> dict:
    """Linear, ridge (α/n as Spark's per-row penalty), random forest."""
    ms = {"linear": LinearRegression(labelCol="target_delay_seconds", regParam=0.0)}
    for a in RIDGE_ALPHAS:
        ms[f"ridge_{int(a)}"] = LinearRegression(labelCol="target_delay_seconds", regParam=a / max(n_train, 1),
                                                 elasticNetParam=0.0)
    ms["random_forest"] = RandomForestRegressor(labelCol="target_delay_seconds", numTrees=RF_TREES,
                                                maxDepth=RF_DEPTH, minInstancesPerNode=RF_MIN_LEAF,
                                                featureSubsetStrategy="all", seed=SEED, cacheNodeIds=True,
                                                maxMemoryInMB=FOREST_MEMORY_MB)
    return ms


def classification_models() -> dict:
    """Logistic regression and random forest for ``target_is_late``."""
    return {"logistic": LogisticRegression(labelCol="target_is_late", maxIter=1000),
            "random_forest": RandomForestClassifier(labelCol="target_is_late", numTrees=RF_TREES,
                                                    maxDepth=RF_DEPTH, minInstancesPerNode=RF_MIN_LEAF,
                                                    featureSubsetStrategy="sqrt", seed=SEED, cacheNodeIds=True,
                                                    maxMemoryInMB=FOREST_MEMORY_MB)}


def forest_sample(train: DataFrame, rows: int) -> DataFrame:
    """At most about ``rows`` training rows, by a 64-bit hash of the row key. No registered job asks for it."""
    n = train.count()
    if n <= rows:
        return train
    h = F.xxhash64("prediction_id", "trip_id", "stop_id", "extracted_at", F.lit("forest"))
    return train.filter(h < F.lit(rows * 2**64 // n - 2**63))


def fit_forest(data: DataFrame, estimator, rows: int | None = None) -> tuple:
    """``fit_predict`` for a forest: codes and trees take all training rows. A caller
    who wants a quick trial may bound a classifier's trees to about ``rows`` of them.
    Scores are the model's, without its vectors."""
    train = data.filter(~F.col("is_test"))
    prep = Pipeline(stages=_prep_stages(scale=False)).fit(train)
    features = NUMERIC_FEATURES + [f"{c}_code" for c in CATEGORICAL_FEATURES]
    classes = isinstance(estimator, RandomForestClassifier)
    ready = prep.transform(forest_sample(train, rows) if classes and rows is not None else train)
    # The saved form of a forest: a model of the same estimator, of one row a class.
    one = data.sparkSession.createDataFrame([(Vectors.dense([0.0] * len(features)), float(y)) for y in range(1 + classes)],
                                            ["features", estimator.getLabelCol()])
    key = F.xxhash64("prediction_id", "trip_id", "stop_id", "extracted_at", F.lit("tree"))
    forest = grow.fit(ready, features, key, estimator, estimator.fit(one))
    model = PipelineModel([*prep.stages, forest])
    tested = prep.transform(data.filter(F.col("is_test"))).drop("features")
    return model, forests.scored(forest, tested, features)


def importance_table(model) -> DataFrame:
    """(rank, feature, importance) of a fitted forest, all features."""
    rows = [(i + 1, f, v) for i, (f, v) in enumerate(feature_importance(model, top=10_000))]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def fit_predict(data: DataFrame, estimator) -> tuple:
    """Fit prep + estimator on the train rows; predictions on the test rows."""
    model = Pipeline(stages=_prep_stages() + [estimator]).fit(data.filter(~F.col("is_test")))
    return model, model.transform(data.filter(F.col("is_test")))


def fit_model(data: DataFrame, estimator) -> tuple:
    """``fit_forest`` for a forest, ``fit_predict`` for any other model."""
    forest = isinstance(estimator, (RandomForestRegressor, RandomForestClassifier))
    return fit_forest(data, estimator) if forest else fit_predict(data, estimator)


# ---------------------------------------------------------------- metrics
def regression_metrics(pred: DataFrame, label="target_delay_seconds", p="prediction") -> DataFrame:
    err = F.col(p) - F.col(label)
    a = pred.select(err.alias("e"), F.col(label).cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("e")).alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.sum(F.col("e") * F.col("e")).alias("ss_res"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("ss_tot"))
    return a.select("n", rha("mae", 3).alias("mae"), rha("rmse", 3).alias("rmse"),
                    rha(F.lit(1.0) - F.col("ss_res") / F.col("ss_tot"), 4).alias("r2"))


def mean_baseline(data: DataFrame) -> DataFrame:
    """Predict the training mean for every test row."""
    mu = data.filter(~F.col("is_test")).agg(F.avg("target_delay_seconds")).scalar()
    return data.filter(F.col("is_test")).withColumn("prediction", mu)


def majority_baseline(data: DataFrame) -> DataFrame:
    """Predict the training majority class."""
    maj = data.filter(~F.col("is_test")).agg(
        F.when(F.avg("target_is_late") >= 0.5, 1.0).otherwise(0.0)).scalar()
    return data.filter(F.col("is_test")).withColumn("prediction", maj) \
        .withColumn("probability_late", maj)


def late_probability(pred: DataFrame) -> DataFrame:
    if "probability" in pred.columns:
        return pred.withColumn("probability_late", vector_to_array("probability")[1])
    return pred


def classification_metrics(pred: DataFrame, label="target_is_late", p="prediction") -> DataFrame:
    y, yh = F.col(label).cast("int"), F.col(p).cast("int")
    a = pred.agg(F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (yh == 1)).alias("tp"),
                 F.count_if((y == 0) & (yh == 1)).alias("fp"), F.count_if((y == 1) & (yh == 0)).alias("fn"),
                 F.count_if((y == 0) & (yh == 0)).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return a.select("n", "tp", "fp", "fn", "tn", rha((tp + tn) / n, 4).alias("accuracy"),
                    rha(prec, 4).alias("precision"), rha(rec, 4).alias("recall"), rha(f1, 4).alias("f1"))


def residual_stats(pred: DataFrame, label="target_delay_seconds") -> DataFrame:
    """Residuals are continuous, so the median is a bounded sketch (rank error 1e-5)."""
    r = F.col("prediction") - F.col(label)
    return pred.agg(rha(F.avg(r), 3).alias("mean_residual"), rha(F.stddev(r), 3).alias("std_residual"),
                    rha(F.percentile_approx(r, 0.5, 100_000), 3).alias("median_residual"),
                    rha(F.min(r), 3).alias("min_residual"), rha(F.max(r), 3).alias("max_residual"))


def best_model(metrics: DataFrame, by: str = "r2") -> DataFrame:
    """The model with the highest ``by`` (ties: model name)."""
    return metrics.agg(F.max_by("model", F.struct(F.col(by), F.col("model"))).alias("best_model"),
                       F.max(by).alias(f"best_{by}"))


# ---------------------------------------------------------------- curves
def score_prefix_sums(pred: DataFrame, score="probability_late", label="target_is_late",
                      partitions: int = 0) -> DataFrame:
    """Cumulative positives / negatives at every distinct score, highest
    score first, computed exactly and in parallel."""
    g = pred.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # Buckets are a function of the score, highest first, so both uses below
    # agree whatever exchange they come from.
    g = g.withColumn("pid", -F.floor(F.col("threshold") * (partitions or SCORE_BUCKETS)))
    w = Window.partitionBy("pid").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = g.withColumn("cpos", F.sum("pos").over(w)).withColumn("cneg", F.sum("neg").over(w))
    tot = g.groupBy("pid").agg(F.sum("pos").alias("ppos"), F.sum("neg").alias("pneg"))
    # bucket offsets: a fixed number of rows, so a global window here is tiny
    wo = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("pid", F.coalesce(F.sum("ppos").over(wo), F.lit(0)).alias("opos"),
                     F.coalesce(F.sum("pneg").over(wo), F.lit(0)).alias("oneg"))
    out = local.join(F.broadcast(off), "pid").select(
        "threshold", "pos", "neg",
        (F.col("cpos") + F.col("opos")).alias("tp"), (F.col("cneg") + F.col("oneg")).alias("fp"))
    totals = pred.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N"))
    return out.select("*", totals.select("P").scalar().alias("P"), totals.select("N").scalar().alias("N"))


def roc_curve(pred: DataFrame) -> DataFrame:
    s = score_prefix_sums(pred)
    return s.select("threshold", (F.col("tp") / F.col("P")).alias("tpr"), (F.col("fp") / F.col("N")).alias("fpr"))


def roc_auc(pred: DataFrame) -> DataFrame:
    """Exact AUC (trapezoids between consecutive ROC points). The previous
    point of a threshold is its prefix sum minus its own counts, so the
    area is a plain sum — no ordering pass over all thresholds."""
    s = score_prefix_sums(pred)
    area = F.col("neg") / F.col("N") * (2 * F.col("tp") - F.col("pos")) / (2 * F.col("P"))
    return s.agg(rha(F.sum(area), 4).alias("auc"))


def pr_curve(pred: DataFrame) -> DataFrame:
    """Precision / recall / F1 at every distinct score threshold."""
    s = score_prefix_sums(pred)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.col("P")
    return s.select("threshold", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


def pr_summary(pred: DataFrame) -> DataFrame:
    """Average precision (Σ ΔR·P) and the best-F1 threshold."""
    s = score_prefix_sums(pred)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.col("tp") / F.col("P")
    c = s.select("threshold", (F.col("pos") / F.col("P")).alias("drec"), prec.alias("precision"),
                 F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))
    return c.agg(rha(F.sum(F.col("drec") * F.col("precision")), 4).alias("average_precision"),
                 F.max_by("threshold", F.struct("f1", "threshold")).alias("best_threshold"),
                 rha(F.max("f1"), 4).alias("best_f1"))


def confusion_matrix(pred: DataFrame, label="target_is_late") -> DataFrame:
    return pred.groupBy(F.col(label).cast("int").alias("actual"),
                        F.col("prediction").cast("int").alias("predicted")).count()


def feature_importance(model, top: int = 15) -> list:
    """(feature, importance) pairs of a fitted forest, largest first."""
    names = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, imp)), key=lambda t: -t[1])[:top]


def with_folds(fm: DataFrame, folds: int = 5, seed: int = SEED) -> DataFrame:
    """R19 input: every complete feature row with a hash fold id in
    [0, folds) — stable under repartitioning, no sampling."""
    fm = with_numeric_flags(fm).dropna(subset=NUMERIC_FEATURES + CATEGORICAL_FEATURES)
    h = F.xxhash64("prediction_id", "trip_id", "stop_id", "extracted_at", F.lit(seed))
    return fm.withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))


def cross_validation(data: DataFrame, models: dict, folds: int = 5, fit=None, side_by_side: int = 4) -> DataFrame:
    """Per-fold scores of each model, with the mean and (population)
    standard deviation over the folds.

    ``models`` maps a name to ``(make_estimator(n_train), metric)`` where
    metric is ``"mae"`` (regression) or ``"f1"`` (classification). Each fold
    fits the whole prep pipeline (codes, scaler) on the other folds, so
    no statistic of the held-out fold leaks into training. ``fit(data,
    estimator)`` gives a fold's predictions (default: a fit of its own). The
    folds are independent Spark jobs; ``side_by_side`` of them run at a time,
    as the cross-validator of ``pyspark.ml`` does. Only the per-fold row counts
    (one row per fold) reach the driver.
    """
    fit = fit or (lambda d, e: fit_model(d, e)[1])
    sizes = {r["fold"]: r["n"] for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    tasks = [(name, make, metric, k) for name, (make, metric) in models.items() for k in range(folds)]

    def one(task):
        name, make, metric, k = task
        pred = fit(data.withColumn("is_test", F.col("fold") == k), make(total - sizes.get(k, 0)))
        met = regression_metrics(pred) if metric == "mae" else classification_metrics(pred)
        return met.select(F.lit(name).alias("model"), F.lit(k).alias("fold"),
                          F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))

    with ThreadPool(side_by_side) as pool:
        rows = pool.map(inheritable_thread_target(data.sparkSession)(one), tasks)
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    w = Window.partitionBy("model")
    return out.select("model", "fold", "metric", "value",
                      rha(F.avg("value").over(w), 4).alias("mean"),
                      rha(F.stddev_pop("value").over(w), 4).alias("std"))


def cv_models(include_forest: bool = False) -> dict:
    """The source's cross-validated models: ridge α=1 (MAE) and, as R19 asks
    for, the two forests (MAE / F1) with the source's settings."""
    ms = {"ridge_1": (lambda n: LinearRegression(labelCol="target_delay_seconds", regParam=1.0 / max(n, 1),
                                                 elasticNetParam=0.0), "mae")}
    if include_forest:
        ms["random_forest_regressor"] = (lambda n: regression_models(n)["random_forest"], "mae")
        ms["random_forest_classifier"] = (lambda n: classification_models()["random_forest"], "f1")
    return ms


# ---------------------------------------------------------------- breakdowns
def error_by_route(pred: DataFrame) -> DataFrame:
    e = F.abs(F.col("prediction") - F.col("target_delay_seconds"))
    return pred.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("n"), rha(F.avg(e), 2).alias("mae"), rha(F.percentile_approx(e, 0.5, 10_000), 2).alias("median_ae"),
        rha(F.avg("target_delay_seconds"), 2).alias("mean_actual"), rha(F.avg("prediction"), 2).alias("mean_predicted"))


def classification_by(pred: DataFrame, key: str) -> DataFrame:
    y, yh = F.col("target_is_late").cast("int"), F.col("prediction").cast("int")
    g = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg((y == yh).cast("double")).alias("acc"),
                              F.count_if((y == 1) & (yh == 1)).alias("tp"), F.count_if(yh == 1).alias("pp"),
                              F.count_if(y == 1).alias("ap"))
    return g.select(key, "n", rha("acc", 4).alias("accuracy"),
                    rha(F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")), 4).alias("precision"),
                    rha(F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")), 4).alias("recall"))


def error_extremes(pred: DataFrame, n: int = 10) -> DataFrame:
    """The n largest under- and over-predictions (signed error)."""
    s = pred.withColumn("signed_error", F.col("prediction") - F.col("target_delay_seconds"))
    cols = ["route_id", "stop_id", "hour_of_day", "target_delay_seconds", "prediction", "signed_error"]
    under = s.orderBy(F.col("signed_error").asc(), "prediction_id", "trip_id").limit(n).select(*cols) \
        .withColumn("kind", F.lit("under"))
    over = s.orderBy(F.col("signed_error").desc(), "prediction_id", "trip_id").limit(n).select(*cols) \
        .withColumn("kind", F.lit("over"))
    return under.unionByName(over)


def error_by_delay_bucket(pred: DataFrame) -> DataFrame:
    e = F.abs(F.col("prediction") - F.col("target_delay_seconds"))
    return pred.groupBy(delay_bucket("target_delay_seconds").alias("delay_bucket")).agg(
        F.count(F.lit(1)).alias("count"), rha(F.avg(e), 2).alias("mae"))


def route_priority(reg_pred: DataFrame, cls_pred: DataFrame) -> DataFrame:
    """40·late rate + 30·(positive mean delay / its max over routes)
    + 30·(1 − classifier accuracy); inputs rounded to 2 decimals first."""
    r = reg_pred.groupBy("route_id").agg(F.count(F.lit(1)).alias("total_predictions"),
                                         rha(F.avg("target_delay_seconds"), 2).alias("avg_delay"),
                                         rha(F.avg("target_is_late"), 2).alias("late_rate"),
                                         rha(F.avg(F.abs(F.col("prediction") - F.col("target_delay_seconds"))), 2)
                                         .alias("model_mae"))
    c = cls_pred.groupBy("route_id").agg(
        rha(F.avg((F.col("target_is_late").cast("int") == F.col("prediction").cast("int")).cast("double")), 2)
        .alias("model_accuracy"))
    j = r.join(c, "route_id", "left")
    pos = F.greatest(F.col("avg_delay"), F.lit(0.0))
    mx = F.max(pos).over(Window.partitionBy())
    score = (F.col("late_rate") * 40 + F.when(mx > 0, pos / mx).otherwise(F.lit(0.0)) * 30
             + (F.lit(1.0) - F.coalesce("model_accuracy", F.lit(0.0))) * 30)
    return j.withColumn("priority_score", rha(score, 1))
