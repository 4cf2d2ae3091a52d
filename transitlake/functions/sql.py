"""The column helpers as SQL functions (``CREATE TEMPORARY FUNCTION … RETURN``),
so ``spark.sql`` users get the same rules as the DataFrame API. They are
SQL-bodied functions: inlined into the plan, no Python in the loop."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _local(ts: str, tz: str) -> str:
    return ts if tz.upper() == "UTC" else f"from_utc_timestamp({ts}, '{tz}')"


def register_sql_functions(spark: SparkSession, tz: str = "UTC", cutoff_hours: int = 3) -> list[str]:
    lt = _local("ts", tz)
    h = f"hour({lt})"
    defs = {
        "tl_day_of_week": "(d DATE) RETURNS INT RETURN dayofweek(d)",
        "tl_is_weekend": "(d DATE) RETURNS BOOLEAN RETURN dayofweek(d) IN (1, 7)",
        "tl_seconds_between": ("(a TIMESTAMP, b TIMESTAMP) RETURNS BIGINT "
                               "RETURN CAST(b AS BIGINT) - CAST(a AS BIGINT)"),
        "tl_array_len": "(a ARRAY<STRING>) RETURNS INT RETURN array_size(a)",
        "tl_parse_ts": "(s STRING) RETURNS TIMESTAMP RETURN CAST(s AS TIMESTAMP)",
        "tl_service_date": (f"(ts TIMESTAMP) RETURNS DATE "
                            f"RETURN to_date({lt} - INTERVAL {int(cutoff_hours)} HOURS)"),
        "tl_service_seconds": (f"(ts TIMESTAMP) RETURNS BIGINT RETURN CAST("
                               f"(CASE WHEN {h} < {int(cutoff_hours)} THEN {h} + 24 ELSE {h} END) * 3600"
                               f" + minute({lt}) * 60 + second({lt}) AS BIGINT)"),
        "tl_round": ("(x DOUBLE, d INT) RETURNS DOUBLE "
                     "RETURN sign(x) * floor(abs(x) * power(10, d) + 0.5) / power(10, d) + 0.0"),
        "tl_delay_category": ("(d BIGINT) RETURNS STRING RETURN CASE WHEN d IS NULL THEN 'unknown' "
                              "WHEN d <= -60 THEN 'early' WHEN d <= 60 THEN 'on_time' "
                              "WHEN d <= 300 THEN 'slightly_late' WHEN d <= 600 THEN 'late' "
                              "ELSE 'very_late' END"),
        "tl_time_period": ("(h INT) RETURNS STRING RETURN CASE WHEN h BETWEEN 6 AND 9 THEN 'morning_rush' "
                           "WHEN h BETWEEN 10 AND 15 THEN 'midday' WHEN h BETWEEN 16 AND 19 THEN "
                           "'evening_rush' WHEN h BETWEEN 20 AND 23 THEN 'evening' ELSE 'overnight' END"),
        "tl_severity_category": ("(s INT) RETURNS STRING RETURN CASE WHEN s >= 7 THEN 'critical' "
                                 "WHEN s >= 4 THEN 'major' WHEN s >= 2 THEN 'minor' ELSE 'informational' END"),
    }
    for name, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(defs)
