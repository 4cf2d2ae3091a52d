"""Feature engineering for delay prediction.

Delays are computed once, in the columns that the matrix needs, and stored;
history aggregates (route, stop) are taken from there and joined back by key; weather is attached by the observation's hour (the
row's own hour, so every delay row gets exactly one weather row — a join
on prediction id alone would fan out, as prediction ids repeat). Floating
aggregates that feed the matrix are rounded to 6 decimals so that results
do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away as rha
from transitlake.session import stored

NUMERIC_FEATURES = ["hour_of_day", "day_of_week", "is_weekend", "is_morning_rush", "is_evening_rush",
                    "raw_stop_sequence", "stop_position_bin", "uncertainty", "direction_id",
                    "route_avg_delay", "route_stddev_delay", "route_late_rate", "stop_avg_delay",
                    "stop_stddev_delay", "stop_late_rate", "temperature_f", "precipitation_mm",
                    "wind_speed_mph", "visibility_m", "is_precipitation_i", "is_snow_i"]
CATEGORICAL_FEATURES = ["route_id", "stop_id"]
DEFAULT_VISIBILITY_M = 24140.0


def _late_rate(cond) -> F.Column:
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def route_history(m) -> DataFrame:
    """R2: per-route history (observations, mean/median/std delay, late rates, p90)."""
    e = m.scheduled_vs_actual.filter(F.col("delay_seconds").isNotNull())
    d = F.col("delay_seconds")
    g = e.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("route_total_obs"), rha(F.avg(d), 2).alias("route_avg_delay"),
        F.percentile(d, F.array(F.lit(0.5), F.lit(0.9))).alias("_q"),
        rha(F.stddev(d), 2).alias("route_stddev_delay"),
        rha(_late_rate(F.col("is_late")), 4).alias("route_late_rate"),
        rha(_late_rate(F.col("is_significantly_late")), 4).alias("route_sig_late_rate"))
    return g.select("route_id", "route_total_obs", "route_avg_delay",
                    rha(F.col("_q")[0], 2).alias("route_median_delay"), "route_stddev_delay",
                    "route_late_rate", "route_sig_late_rate", rha(F.col("_q")[1], 2).alias("route_p90_delay"))


def stop_history(m) -> DataFrame:
    """Per-stop history."""
    e = m.scheduled_vs_actual.filter(F.col("delay_seconds").isNotNull())
    d = F.col("delay_seconds")
    return e.groupBy("stop_id").agg(
        F.count(F.lit(1)).alias("stop_total_obs"), rha(F.avg(d), 2).alias("stop_avg_delay"),
        rha(F.median(d), 2).alias("stop_median_delay"), rha(F.stddev(d), 2).alias("stop_stddev_delay"),
        rha(_late_rate(F.col("is_late")), 4).alias("stop_late_rate"))


def weather_features(m) -> DataFrame:
    """Weather attributes of each delay observation."""
    w = m.weather_transit.filter(F.col("delay_seconds").isNotNull())
    return w.select("prediction_id", "trip_id", "stop_id", "prediction_hour", "temperature_f",
                    "humidity_pct", "precipitation_mm", "rain_mm", "snowfall_cm", "wind_speed_mph",
                    "wind_gusts_mph", "visibility_m", "weather_code", "weather_condition",
                    "is_precipitation", "is_snow", "is_low_visibility", "is_high_wind", "delay_seconds")


def alert_features(m) -> DataFrame:
    """Active alerts per route (count, max severity, entities affected)."""
    a = m.alert_summary.filter(F.col("is_active") & F.col("affected_routes").isNotNull())
    e = a.select(F.explode("affected_routes").alias("route_id"), "severity", "informed_entity_count")
    return e.groupBy("route_id").agg(F.count(F.lit(1)).alias("active_alerts"),
                                     F.max("severity").alias("max_alert_severity"),
                                     F.sum("informed_entity_count").alias("total_entities_affected"))


def fold_of(folds: int) -> F.Column:
    """A fold in [0, folds) by a hash of the row's key that any engine can restate."""
    key = F.concat_ws("|", "prediction_id", "trip_id", "stop_id", F.unix_micros("extracted_at").cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % folds).cast("int")


def train_history(e: DataFrame, key: str, names: tuple[str, str, str], test_fold: int = 0) -> DataFrame:
    """Mean, deviation and late rate of ``key`` for each ``fold``, from the training rows outside that fold.

    One aggregate per (key, fold); a fold's history is the key's training
    total less the fold's own part. So neither a row nor its fold-mates move
    its own features, and test rows move nobody's.
    """
    d = F.col("delay_seconds").cast("long")
    own = e.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"),
                                     F.sum(d * d).alias("q"), F.count_if("is_late").alias("l"))
    train = F.col("fold") != test_fold
    w = Window.partitionBy(key)
    rest = [(F.sum(F.when(train, F.col(c)).otherwise(0)).over(w)
             - F.when(train, F.col(c)).otherwise(0)).cast("double").alias(c.upper()) for c in "nsql"]
    n, s, q, l = (F.col(c) for c in "NSQL")
    var = (q - s * s / n) / (n - 1)
    mean, dev, rate = names
    return own.select(key, "fold", *rest).select(
        key, "fold", F.when(n > 0, rha(s / n, 6)).alias(mean),
        F.when(n > 1, rha(F.sqrt(F.greatest(var, F.lit(0.0))), 6)).alias(dev), F.when(n > 0, rha(l / n, 6)).alias(rate))


def feature_matrix(m, fit_on: str = "all", folds: int = 5) -> DataFrame:
    """R1 + R6: one row per delay observation with targets and features.

    ``fit_on="all"`` takes route and stop history over all rows, the row's own
    included, as the source does. ``fit_on="train"`` adds ``fold`` (fold 0 is
    the test set) and takes history from the training rows of other folds.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on is 'all' or 'train', not {fit_on!r}")
    e = m.feature_delays
    ts = F.col("extracted_at")
    hour, dow = F.hour(ts), F.dayofweek(ts) - 1          # 0 = Sunday
    seq = F.col("stop_sequence")
    fold = ["fold"] if fit_on == "train" else []
    if fold:
        e = e.withColumn("fold", fold_of(folds))
    base = e.select(
        *fold, "prediction_id", "trip_id", "route_id", "stop_id", "direction_id", "stop_sequence",
        "extracted_at", "delay_seconds", "is_late",
        F.col("delay_seconds").alias("target_delay_seconds"),
        F.when(F.col("delay_seconds") > 60, 1).otherwise(0).alias("target_is_late"),
        hour.alias("hour_of_day"), dow.alias("day_of_week"),
        F.when(dow.isin(0, 6), 1).otherwise(0).alias("is_weekend"),
        F.when(hour.between(6, 9), 1).otherwise(0).alias("is_morning_rush"),
        F.when(hour.between(16, 19), 1).otherwise(0).alias("is_evening_rush"),
        seq.alias("raw_stop_sequence"),
        F.when(seq <= 5, 0).when(seq <= 15, 1).otherwise(2).alias("stop_position_bin"),
        F.coalesce("arrival_uncertainty", "departure_uncertainty", F.lit(0)).alias("uncertainty"),
        F.date_trunc("hour", F.coalesce("predicted_arrival", "predicted_departure")).alias("_hour"))
    d = F.col("delay_seconds")
    ra = e.groupBy("route_id").agg(rha(F.avg(d), 6).alias("ra"), rha(F.stddev(d), 6).alias("rs"),
                                   rha(_late_rate(F.col("is_late")), 6).alias("rl"))
    sa = e.groupBy("stop_id").agg(rha(F.avg(d), 6).alias("sa"), rha(F.stddev(d), 6).alias("ss"),
                                  rha(_late_rate(F.col("is_late")), 6).alias("sl"))
    w = m.stg_weather.select(F.col("weather_timestamp").alias("_hour"), "temperature_f",
                             "precipitation_mm", "wind_speed_mph", "visibility_m", "snowfall_cm")
    if fold:
        ra, sa = train_history(e, "route_id", ("ra", "rs", "rl")), train_history(e, "stop_id", ("sa", "ss", "sl"))
    # A row per route and per hour of the time span: short beside the rows, which so are shuffled for the stops
    # at most, and not for these where their stored table is small.
    j = (base.join(F.broadcast(ra), ["route_id", *fold], "left").join(stored(sa), ["stop_id", *fold], "left")
         .join(F.broadcast(w), "_hour", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(
        *fold, "prediction_id", "trip_id", "route_id", "stop_id", "direction_id", "stop_sequence",
        "extracted_at", "delay_seconds", "is_late", "target_delay_seconds", "target_is_late",
        "hour_of_day", "day_of_week", "is_weekend", "is_morning_rush", "is_evening_rush",
        "raw_stop_sequence", "stop_position_bin", "uncertainty",
        z("ra").alias("route_avg_delay"), z("rs").alias("route_stddev_delay"), z("rl").alias("route_late_rate"),
        z("sa").alias("stop_avg_delay"), z("ss").alias("stop_stddev_delay"), z("sl").alias("stop_late_rate"),
        z("temperature_f").alias("temperature_f"), z("precipitation_mm").alias("precipitation_mm"),
        z("wind_speed_mph").alias("wind_speed_mph"),
        F.coalesce("visibility_m", F.lit(DEFAULT_VISIBILITY_M)).alias("visibility_m"),
        F.coalesce(F.col("precipitation_mm") > 0, F.lit(False)).alias("is_precipitation"),
        F.coalesce(F.col("snowfall_cm") > 0, F.lit(False)).alias("is_snow"))


def with_numeric_flags(fm: DataFrame) -> DataFrame:
    return fm.withColumn("is_precipitation_i", F.col("is_precipitation").cast("int")) \
             .withColumn("is_snow_i", F.col("is_snow").cast("int"))


def pearson(x, y) -> F.Column:
    """Sample Pearson correlation; NULL (not an error) for a constant column."""
    return F.try_divide(F.covar_samp(x, y), F.stddev(x) * F.stddev(y))


def feature_profile(fm: DataFrame, target: str = "target_delay_seconds") -> DataFrame:
    """NULL % and Pearson correlation with the target for every
    numeric feature, from one aggregate pass, unpivoted."""
    fm = with_numeric_flags(fm)
    n = F.count(F.lit(1))
    aggs = []
    for c in NUMERIC_FEATURES:
        aggs.append(F.struct(F.lit(c).alias("feature"),
                             rha(F.count_if(F.col(c).isNull()) * 100.0 / n, 2).alias("null_pct"),
                             rha(pearson(F.col(c).cast("double"), F.col(target).cast("double")), 4).alias("corr")))
    return fm.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def late_distribution(fm: DataFrame, features=("hour_of_day", "stop_position_bin", "is_weekend",
                                                 "day_of_week")) -> DataFrame:
    """Late vs on-time counts per value of selected features.

    One pass over the matrix: each row is unpivoted to its (feature, value)
    pairs, which the partial aggregate folds into a few groups a task.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in features])
    late = F.col("target_is_late")
    return (fm.select("target_is_late", F.explode(pairs).alias("p")).groupBy("p.feature", "p.value")
            .agg(F.count_if(late == 1).alias("late"), F.count_if(late == 0).alias("on_time"))
            .withColumn("late_pct", rha(F.col("late") * 100.0 / (F.col("late") + F.col("on_time")), 2))
            .select("feature", "value", "late", "on_time", "late_pct"))


def write_feature_matrix(fm: DataFrame, path: str) -> str:
    """C14: persist the matrix as Parquet for training jobs, ranged and sorted by (route, stop, prediction).

    A range splits a route of many rows over several files, and min/max
    statistics prune the scans of single routes and stops.
    """
    order = ["route_id", "stop_id", "prediction_id"]
    fm.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return path


def read_feature_matrix(spark, path: str) -> DataFrame:
    """Read a saved feature matrix."""
    return spark.read.parquet(path)
