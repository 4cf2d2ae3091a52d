"""Data-quality suites as one aggregate pass per table.

All metrics a suite needs (row count, NULL counts, distinct counts, min /
max) are computed in a single ``agg``; the checks are then unpivoted into
result rows ``(entity, check, passed, expected, actual, details)`` inside
the plan — no job per check, nothing collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.functions.core import lit_ts, round_half_away

# ---------------------------------------------------------------------------
# Expected columns, not-null / unique columns, minimum row
# counts and valid ranges per raw entity.
# ---------------------------------------------------------------------------
EXPECTED = {
    "routes": dict(required=["route_id", "long_name", "route_type", "route_type_desc", "color", "description"],
                   not_null=["route_id", "long_name", "route_type"], unique=["route_id"]),
    "stops": dict(required=["stop_id", "name", "latitude", "longitude", "municipality", "location_type"],
                  not_null=["stop_id", "name"], unique=["stop_id"]),
    "trips": dict(required=["trip_id", "route_id", "direction_id", "service_id"],
                  not_null=["trip_id", "route_id"], unique=["trip_id"]),
    "schedules": dict(required=["schedule_id", "trip_id", "stop_id", "route_id", "stop_sequence"],
                      not_null=["schedule_id", "trip_id", "stop_id"], unique=["schedule_id"]),
    "predictions": dict(required=["prediction_id", "route_id", "stop_id", "trip_id", "extracted_at"],
                        not_null=["prediction_id", "route_id", "extracted_at"], unique=[]),
    "vehicles": dict(required=["vehicle_id", "route_id", "latitude", "longitude", "current_status", "extracted_at"],
                     not_null=["vehicle_id", "route_id", "extracted_at"], unique=[]),
    "alerts": dict(required=["alert_id", "cause", "effect", "severity", "header", "extracted_at"],
                   not_null=["alert_id", "severity", "extracted_at"], unique=[]),
    "weather": dict(required=["timestamp", "temperature_2m", "precipitation", "wind_speed_10m", "weather_code"],
                    not_null=["timestamp", "temperature_2m"], unique=["timestamp"]),
}
MIN_ROWS = {"routes": 100, "stops": 5000, "trips": 1000, "schedules": 5000, "predictions": 100,
            "vehicles": 10, "alerts": 1, "weather": 24}
# Warehouse minimum rows of the daily row-count check (P10), per raw table.
WAREHOUSE_MIN_ROWS = {"raw_routes": 100, "raw_stops": 5000, "raw_predictions": 500, "raw_vehicles": 10}
RANGES = {
    "stops": {"latitude": (41.0, 43.0), "longitude": (-72.0, -70.0)},
    "vehicles": {"latitude": (41.0, 43.0), "longitude": (-72.0, -70.0)},
    "weather": {"temperature_2m": (-40.0, 120.0), "precipitation": (0.0, 500.0),
                "wind_speed_10m": (0.0, 200.0)},
    "routes": {"route_type": (0, 4)},
}
# Freshness limits in hours: snapshot facts vs. everything else.
FRESHNESS_HOURS = {"predictions": 0.5, "vehicles": 0.5}
FRESHNESS_DEFAULT_HOURS = 25.0
# ---------------------------------------------------------------------------

RESULT_SCHEMA = "entity string, check string, passed boolean, expected string, actual string, details string"


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _check(entity: str, name: str, passed: Column, expected: str, actual: Column,
           details: Column | None = None) -> Column:
    return F.struct(F.lit(entity).alias("entity"), F.lit(name).alias("check"),
                    passed.alias("passed"), F.lit(expected).alias("expected"),
                    actual.cast("string").alias("actual"),
                    (details if details is not None else F.lit(None).cast("string")).alias("details"))


def validate(df: DataFrame, entity: str) -> DataFrame:
    """Run the entity's suite over ``df``; one result row per check."""
    spec = EXPECTED.get(entity, dict(required=[], not_null=[], unique=[]))
    cols = set(df.columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in spec["not_null"]:
        if c in cols:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"null__{c}"))
    for c in spec["unique"]:
        if c in cols:
            aggs.append((F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"uniq__{c}"))
    rng = RANGES.get(entity, {})
    for c in rng:
        if c in cols:
            aggs += [F.min(c).alias(f"min__{c}"), F.max(c).alias(f"max__{c}")]
    a = df.agg(*aggs)
    n = F.col("n")
    min_rows = MIN_ROWS.get(entity, 1)
    checks = [_check(entity, "min_row_count", n >= min_rows, f">= {min_rows}", n)]
    for c in spec["required"]:
        ok = c in cols
        checks.append(_check(entity, f"column_exists:{c}", F.lit(ok), "present",
                             F.lit("present" if ok else "missing")))
    for c in spec["not_null"]:
        if c in cols:
            nulls = F.col(f"null__{c}")
            pct = F.when(n > 0, nulls * 100.0 / n).otherwise(F.lit(0.0))
            checks.append(_check(entity, f"not_null:{c}", nulls == 0, "0", nulls,
                                 F.concat(round_half_away(pct, 1).cast("string"), F.lit("% null"))))
    for c in spec["unique"]:
        if c in cols:
            u = F.col(f"uniq__{c}")
            checks.append(_check(entity, f"unique:{c}", u == n, "total", u,
                                 F.concat((n - u).cast("string"), F.lit(" duplicates"))))
    for c, (lo, hi) in rng.items():
        if c in cols:
            mn, mx = F.col(f"min__{c}"), F.col(f"max__{c}")
            ok = (mn.isNull() | (mn >= float(lo))) & (mx.isNull() | (mx <= float(hi)))
            checks.append(_check(entity, f"valid_range:{c}", ok, f"[{lo}, {hi}]",
                                 F.concat(F.lit("["), _s(mn), F.lit(", "), _s(mx), F.lit("]"))))
    checks.append(_check(entity, "not_empty", n > 0, "> 0 rows", F.concat(n.cast("string"), F.lit(" rows"))))
    return a.select(F.explode(F.array(*checks)).alias("r")).select("r.*")


def summarize(results: DataFrame) -> DataFrame:
    """Suite summary per entity: pass / fail counts and overall pass."""
    return (results.groupBy("entity")
            .agg(F.count(F.lit(1)).alias("total_checks"),
                 F.count_if(F.col("passed")).alias("passed_checks"),
                 F.count_if(~F.col("passed")).alias("failed_checks"))
            .withColumn("success", F.col("failed_checks") == 0))


def validate_all(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        r = validate(df, name)
        out = r if out is None else out.unionByName(r)
    return out


def readable(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """File/table readability as a result row instead of an exception."""
    try:
        n = spark.read.parquet(path).limit(1).count()
        ok, actual = True, f"{n} sampled rows"
    except Exception as e:  # noqa: BLE001 - a failing result, not a crash
        ok, actual = False, type(e).__name__
    return spark.createDataFrame([(entity, "readable", ok, "readable", actual, path)], RESULT_SCHEMA)


def freshness(tables: dict[str, DataFrame], now) -> DataFrame:
    """Age of the newest ``extracted_at`` (or ``timestamp``) vs. the limit."""
    now_c = now if isinstance(now, Column) else lit_ts(now)
    out = None
    for name, df in tables.items():
        col = "extracted_at" if "extracted_at" in df.columns else "timestamp"
        limit = FRESHNESS_HOURS.get(name, FRESHNESS_DEFAULT_HOURS)
        latest = F.max(F.col(col).cast("timestamp"))
        age_h = (now_c.cast("long") - latest.cast("long")) / 3600.0
        r = df.agg(_check(name, "freshness", F.coalesce(age_h <= limit, F.lit(False)),
                          f"<= {limit} h", F.coalesce(round_half_away(age_h, 2).cast("string"), F.lit("missing")))
                   .alias("r")).select("r.*")
        out = r if out is None else out.unionByName(r)
    return out


# -- schema tests on models (not_null / unique / accepted_values / relationships)
@dataclass
class SchemaTests:
    not_null: list = field(default_factory=list)
    unique: list = field(default_factory=list)
    accepted: dict = field(default_factory=dict)
    relationships: list = field(default_factory=list)   # (column, parent_name, parent_column)


STAGING_TESTS = {
    "stg_routes": SchemaTests(not_null=["route_id", "long_name", "route_type"], unique=["route_id"],
                              accepted={"route_type": [0, 1, 2, 3, 4]}),
    "stg_stops": SchemaTests(not_null=["stop_id", "stop_name", "latitude", "longitude"], unique=["stop_id"]),
    "stg_trips": SchemaTests(not_null=["trip_id", "route_id"], unique=["trip_id"],
                             relationships=[("route_id", "stg_routes", "route_id")]),
    "stg_schedules": SchemaTests(not_null=["schedule_id", "trip_id", "stop_id"]),
    "stg_predictions": SchemaTests(not_null=["prediction_id", "trip_id", "stop_id", "extracted_at"]),
    "stg_vehicles": SchemaTests(not_null=["vehicle_id", "extracted_at"]),
    "stg_alerts": SchemaTests(not_null=["alert_id"], unique=["alert_id"]),
    "stg_weather": SchemaTests(not_null=["weather_timestamp"], unique=["weather_timestamp"]),
}


MODEL_TESTS = {
    "int_scheduled_vs_actual": SchemaTests(not_null=["prediction_id"]),
    "int_stop_activity": SchemaTests(not_null=["stop_id", "activity_hour"]),
    "int_alert_impacts": SchemaTests(not_null=["alert_id"]),
    "int_weather_transit": SchemaTests(not_null=["prediction_id"]),
    "mart_route_reliability": SchemaTests(not_null=["route_id", "route_name"]),
    "mart_stop_performance": SchemaTests(not_null=["stop_id"]),
    "mart_delay_analysis": SchemaTests(not_null=["route_id"]),
    "mart_alert_summary": SchemaTests(not_null=["alert_id"], unique=["alert_id"]),
}

SOURCE_TESTS = {
    "raw_routes": SchemaTests(not_null=["route_id"], unique=["route_id"]),
    "raw_stops": SchemaTests(not_null=["stop_id"], unique=["stop_id"]),
    "raw_trips": SchemaTests(not_null=["trip_id"]),
    "raw_schedules": SchemaTests(not_null=["schedule_id"]),
    "raw_predictions": SchemaTests(not_null=["prediction_id"]),
    "raw_vehicles": SchemaTests(not_null=["vehicle_id"]),
    "raw_alerts": SchemaTests(not_null=["alert_id"]),
    "raw_weather": SchemaTests(not_null=["timestamp"]),
}


def schema_tests(models: dict[str, DataFrame], tests: dict[str, SchemaTests]) -> DataFrame:
    """dbt-style tests: failing-row counts per test (status pass / fail / warn).

    not_null / accepted_values / unique come from one aggregate per model;
    relationships are a ``left_anti`` join count and only warn.
    """
    rows = None

    def add(df):
        nonlocal rows
        rows = df if rows is None else rows.unionByName(df)

    for name, t in tests.items():
        df = models[name]
        aggs = []
        for c in t.not_null:
            aggs.append(F.struct(F.lit(f"not_null:{c}").alias("test"),
                                 F.count_if(F.col(c).isNull()).alias("failures"),
                                 F.lit("error").alias("severity")))
        for c, vals in t.accepted.items():
            aggs.append(F.struct(F.lit(f"accepted_values:{c}").alias("test"),
                                 F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*vals)).alias("failures"),
                                 F.lit("error").alias("severity")))
        if aggs:
            add(df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r"))
                .select(F.lit(name).alias("model"), "r.*"))
        for c in t.unique:
            dup = (df.filter(F.col(c).isNotNull()).groupBy(c).count().filter(F.col("count") > 1)
                   .agg(F.count(F.lit(1)).alias("failures")))
            add(dup.select(F.lit(name).alias("model"), F.lit(f"unique:{c}").alias("test"),
                           "failures", F.lit("error").alias("severity")))
        for c, parent, pc in t.relationships:
            p = models[parent].select(F.col(pc).alias("_pk"))
            orphans = df.filter(F.col(c).isNotNull()).join(p, F.col(c) == F.col("_pk"), "left_anti")
            add(orphans.agg(F.count(F.lit(1)).alias("failures"))
                .select(F.lit(name).alias("model"), F.lit(f"relationships:{c}->{parent}.{pc}").alias("test"),
                        "failures", F.lit("warn").alias("severity")))
    return rows.withColumn("status", F.when(F.col("failures") == 0, F.lit("pass"))
                           .when(F.col("severity") == "warn", F.lit("warn")).otherwise(F.lit("fail")))


def minimum_rows(counts: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Warehouse minimum-row check over a (table_name, row_count) frame."""
    spark = counts.sparkSession
    th = spark.createDataFrame(list(thresholds.items()), "table_name string, min_rows long")
    return (th.join(counts, "table_name", "left")
            .select("table_name", F.coalesce("row_count", F.lit(0)).alias("row_count"), "min_rows",
                    (F.coalesce("row_count", F.lit(0)) >= F.col("min_rows")).alias("passed")))


# -- checks declared by the source design but not implemented there (P14) ----
def no_future_timestamps(df: DataFrame, entity: str, columns, now) -> DataFrame:
    """Rows whose instants lie after ``now`` (one aggregate, one result row per column)."""
    now_c = now if isinstance(now, Column) else lit_ts(now)
    checks = [_check(entity, f"no_future:{c}", F.count_if(F.col(c).cast("timestamp") > now_c) == 0, "0",
                     F.count_if(F.col(c).cast("timestamp") > now_c)) for c in columns]
    return df.agg(F.array(*checks).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def delay_in_range(df: DataFrame, lo: int = -1800, hi: int = 3600, col: str = "delay_seconds") -> DataFrame:
    """Delay values outside the accepted window."""
    bad = F.count_if(F.col(col).isNotNull() & ~F.col(col).between(lo, hi))
    return df.agg(_check("delays", f"valid_delay_range:{col}", bad == 0, f"[{lo}, {hi}]", bad).alias("r")) \
        .select("r.*")


def row_count_drift(current: DataFrame, previous: DataFrame, max_change_pct: float = 50.0) -> DataFrame:
    """Relative change of (table_name, row_count) between two snapshots."""
    p = previous.select("table_name", F.col("row_count").alias("previous_count"))
    j = current.join(p, "table_name", "full_outer")
    cur, prev = F.coalesce("row_count", F.lit(0)), F.col("previous_count")
    change = F.when(prev > 0, (cur - prev) * 100.0 / prev)
    return j.select("table_name", cur.alias("row_count"), "previous_count",
                    round_half_away(change, 1).alias("change_pct"),
                    F.coalesce(F.abs(change) <= max_change_pct, F.lit(True)).alias("passed"))
