"""Exploration and presentation queries: group counts, histograms, box
statistics, ranks, name join-backs, default windows, free-text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from transitlake.functions.core import round_half_away as rha, service_date
from transitlake.plans.queries.common import top

# Bins of the delay histogram, delay range of the box statistics.
HISTOGRAM_BINS = 80
BOX_RANGE = (-600, 1200)


def group_counts(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first (ties by value); the ``n`` first."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return top(g, n, F.col("count").desc(), F.col(key).asc_nulls_first())


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value.

    The range is a one-row aggregate; binning is a projection and a partial
    aggregate with at most ``bins`` groups. The last bin holds the maximum.
    """
    x = F.col(col).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    step = (hi - lo) / F.lit(float(bins))
    at = F.when(step > 0, F.least(F.floor((x - lo) / step), F.lit(bins - 1))).otherwise(F.lit(0))
    g = df.filter(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", rha(lo + step * F.col("bin"), 4).alias("from_value"), "count")


def box_stats(df: DataFrame, key: str, col: str, lo: int = BOX_RANGE[0], hi: int = BOX_RANGE[1]) -> DataFrame:
    """Quartiles, extremes and count per group, of whole values in [lo, hi].

    Exact: ``percentile`` keeps counts per distinct value, at most
    ``hi - lo + 1`` of them.
    """
    x = df.filter(F.col(col).between(lo, hi))
    q = F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = x.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.min(col).alias("min"), F.max(col).alias("max"),
                           q.alias("q"))
    return g.select(key, "count", "min", rha(F.col("q")[0], 2).alias("q1"), rha(F.col("q")[1], 2).alias("median"),
                    rha(F.col("q")[2], 2).alias("q3"), "max")


def approx_quantile(col: str, p: float, accuracy: int = 10_000) -> Column:
    """An approximate quantile (rank error ``1 / accuracy``, bounded state)."""
    return F.percentile_approx(col, p, accuracy)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Position in the ordered list, from 1 (for lists the size of a report)."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def with_route_names(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Route names joined back to a result keyed by route id."""
    names = routes.select("route_id", F.col("long_name").alias("route_name"))
    return df.join(names, "route_id", "left")


def alert_text_filter(alerts: DataFrame, text: str) -> DataFrame:
    """Alerts whose header, effect or affected routes contain ``text``."""
    said = F.lower(F.concat_ws("\n", "header", "service_effect", F.concat_ws(",", "affected_routes")))
    return alerts.filter(said.contains(text.lower()))


def default_window(now: Column, start: str | None = None, end: str | None = None, tz: str = "UTC") -> tuple:
    """M9: first and last service date; yesterday and eight days on by default."""
    first = F.lit(start).cast("date") if start else F.date_sub(service_date(now, tz), 1)
    last = F.lit(end).cast("date") if end else F.date_add(first, 8)
    return first, last


def service_days(m, now: Column, tz: str = "UTC") -> DataFrame:
    """M9: scheduled stop visits of every date in the default window, zeros included."""
    spark = m.raw.schedules.sparkSession
    first, last = default_window(now, tz=tz)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("service_date"))
    s = m.raw.schedules.filter(F.col("departure_time").isNotNull()).select(
        service_date(F.col("departure_time").cast("timestamp"), tz).alias("service_date"))
    n = s.groupBy("service_date").agg(F.count(F.lit(1)).alias("stop_visits"))
    return days.join(n, "service_date", "left").select(
        "service_date", F.coalesce("stop_visits", F.lit(0)).alias("stop_visits"))


def class_report(pred: DataFrame, label: str = "target_is_late", p: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    y, yh = F.col(label).cast("int"), F.col(p).cast("int")
    marks = pred.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), y.alias("y"), yh.alias("yh"))
    c = F.col("class")
    g = marks.groupBy("class").agg(F.count_if((F.col("y") == c) & (F.col("yh") == c)).alias("hit"),
                                   F.count_if(F.col("yh") == c).alias("said"), F.count_if(F.col("y") == c).alias("support"))
    prec = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select("class", rha(prec, 4).alias("precision"), rha(rec, 4).alias("recall"), rha(f1, 4).alias("f1"),
                    "support")
