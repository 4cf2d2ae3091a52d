"""Registration of load-rule (C) and data-quality (P) jobs with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transitlake.operators import history, loads, quality
from transitlake.plans import intermediate
from transitlake.plans.oracle_sql import CTES, rnd
from transitlake.plans.queries import stations as qst
from transitlake.plans.registry import register, register_raw
from transitlake.session import checkpoint_dir
from transitlake.sources.proxy import ENTITIES
from transitlake.sources.schemas import DEDUPE_KEYS, PREDICTIONS, VEHICLES

NOW_FRESH = "2024-01-31 00:00:00"
# Landing stamp of the dimension batch (their rows carry no instant of their own).
LANDED_AT = "2024-01-30 12:30:00"


def _resnapshot(df, seconds: int):
    return df.withColumn("extracted_at", F.col("extracted_at") + F.expr(f"INTERVAL {seconds} SECONDS"))


def _rank_sql(cols, keys):
    rest = [c for c in cols if c not in keys]
    order = ", ".join(f"{c} DESC NULLS LAST" for c in rest)
    return f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {order})"


# C4: replaying a batch plus a new snapshot of the same predictions.
_PCOLS = [f.name for f in PREDICTIONS.fields]
_PK = list(DEDUPE_KEYS["predictions"])
_shift = ", ".join(c if c != "extracted_at" else "extracted_at + INTERVAL 300 SECOND AS extracted_at" for c in _PCOLS)
_ns = " AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in _PK)
register("c4_idempotent_append", f"""
WITH tgt AS (SELECT * FROM raw_predictions),
src AS (SELECT * FROM raw_predictions UNION ALL SELECT {_shift} FROM raw_predictions),
ins AS (SELECT * FROM (SELECT DISTINCT * FROM src) s WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE {_ns})),
allr AS (SELECT * FROM tgt UNION ALL SELECT * FROM ins)
SELECT {', '.join(_PCOLS)} FROM (SELECT *, {_rank_sql(_PCOLS, _PK)} AS _rk FROM allr) x WHERE _rk = 1""")(
    lambda m: appended(m))


def _store(m, name: str) -> loads.RawStore:
    # The synthetic snapshots spread over seven years: months, not days.
    return loads.RawStore(m.spark, f"{checkpoint_dir(m.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}", unit="month")


def appended(m):
    """The stored table after a first load and a batch that replays it and adds a snapshot of every row."""
    store, p = _store(m, "c4"), m.raw.predictions
    store.load("predictions", p, count=False)
    store.load("predictions", p.unionByName(_resnapshot(p, 300)), count=False)
    return store.rows("predictions").select(*_PCOLS)


# Batches merged on their keys through a staged copy, the second one holding the first again.
def merged(m):
    store, p = _store(m, "c7"), m.raw.predictions
    store.merge("predictions", p.filter(F.col("direction_id") == 0))
    store.merge("predictions", p)
    return store.rows("predictions").select(*_PCOLS)


register("c7_merge_on_keys", f"""
SELECT {', '.join(_PCOLS)} FROM (SELECT *, {_rank_sql(_PCOLS, _PK)} AS _rk
  FROM (SELECT *, min(direction_id) OVER (PARTITION BY {', '.join(_PK)}) AS _first FROM raw_predictions)
  WHERE direction_id = _first) x WHERE _rk = 1""")(merged)

# De-duplicating a table that holds a replayed batch with changed values.
_VCOLS = [f.name for f in VEHICLES.fields]
_VK = list(DEDUPE_KEYS["vehicles"])
_vbump = ", ".join(c if c != "speed" else "speed + 1.0::DOUBLE AS speed" for c in _VCOLS)
register("c8_dedupe_vehicles", f"""
WITH allr AS (SELECT * FROM raw_vehicles UNION ALL SELECT {_vbump} FROM raw_vehicles)
SELECT {', '.join(_VCOLS)} FROM (SELECT *, {_rank_sql(_VCOLS, _VK)} AS _rk FROM allr) x WHERE _rk = 1""")(
    lambda m: deduped(m))


def deduped(m):
    """A stored table that another writer filled with copies, after the store's own de-duplication."""
    store, v = _store(m, "c8"), m.raw.vehicles
    v.unionByName(v.withColumn("speed", F.col("speed") + 1.0)).write.parquet(store.table_path("vehicles"))
    store.dedupe("vehicles")
    return store.rows("vehicles").select(*_VCOLS)

# Row counts of the raw tables.
register("c10_table_stats", "\nUNION ALL ".join(
    f"SELECT 'raw_{e}' AS table_name, count(*) AS row_count FROM raw_{e}" for e in ENTITIES))(
    lambda m: _stats(m))


def _stats(m):
    out = None
    for e in ENTITIES:
        p = getattr(m.raw, e).agg(F.lit(f"raw_{e}").alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = p if out is None else out.unionByName(p)
    return out


# GeoJSON features of route lines (JSON text; no SQL oracle: the
# engines format JSON numbers differently).
register("c16_geojson_route_lines")(lambda m: loads.route_lines_geojson(qst.route_lines(m)))


# Entity suites over all raw tables.
def _suite_sql(entity: str) -> str:
    spec = quality.EXPECTED[entity]
    cols = {f for f in _raw_cols(entity)}
    aggs = ["count(*) AS n"]
    aggs += [f"count(CASE WHEN \"{c}\" IS NULL THEN 1 END) AS null__{c}" for c in spec["not_null"] if c in cols]
    aggs += [f"count(DISTINCT \"{c}\") + max(CASE WHEN \"{c}\" IS NULL THEN 1 ELSE 0 END) AS uniq__{c}"
             for c in spec["unique"] if c in cols]
    rng = quality.RANGES.get(entity, {})
    aggs += [f"min(\"{c}\") AS min__{c}, max(\"{c}\") AS max__{c}" for c in rng if c in cols]
    mr = quality.MIN_ROWS.get(entity, 1)
    rows = [f"SELECT 'min_row_count' AS check, n >= {mr} AS passed, '>= {mr}' AS expected, CAST(n AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS details FROM a"]
    for c in spec["required"]:
        ok = c in cols
        rows.append(f"SELECT 'column_exists:{c}', {str(ok).upper()}, 'present', '{'present' if ok else 'missing'}', NULL FROM a")
    for c in spec["not_null"]:
        if c in cols:
            pct = f"CASE WHEN n > 0 THEN null__{c} * 100.0::DOUBLE / n ELSE 0.0::DOUBLE END"
            rows.append(f"SELECT 'not_null:{c}', null__{c} = 0, '0', CAST(null__{c} AS VARCHAR), "
                        f"CAST({rnd(pct, 1)} AS VARCHAR) || '% null' FROM a")
    for c in spec["unique"]:
        if c in cols:
            rows.append(f"SELECT 'unique:{c}', uniq__{c} = n, 'total', CAST(uniq__{c} AS VARCHAR), "
                        f"CAST(n - uniq__{c} AS VARCHAR) || ' duplicates' FROM a")
    for c, (lo, hi) in rng.items():
        if c in cols:
            rows.append(f"SELECT 'valid_range:{c}', (min__{c} IS NULL OR min__{c} >= {lo}) AND (max__{c} IS NULL OR max__{c} <= {hi}), "
                        f"'[{lo}, {hi}]', '[' || coalesce(CAST(min__{c} AS VARCHAR), 'None') || ', ' || "
                        f"coalesce(CAST(max__{c} AS VARCHAR), 'None') || ']', NULL FROM a")
    rows.append("SELECT 'not_empty', n > 0, '> 0 rows', CAST(n AS VARCHAR) || ' rows', NULL FROM a")
    body = "\n  UNION ALL ".join(rows)
    return (f"SELECT '{entity}' AS entity, * FROM (WITH a AS (SELECT {', '.join(aggs)} FROM raw_{entity})\n"
            f"  {body}) q")


def _raw_cols(entity: str):
    from transitlake.sources import schemas
    return [f.name for f in getattr(schemas, entity.upper()).fields]


register("p8_quality_suite_raw", "\nUNION ALL\n".join(_suite_sql(e) for e in ENTITIES))(
    lambda m: quality.validate_all({e: getattr(m.raw, e) for e in ENTITIES}))

register("p8b_quality_summary_raw", f"""
SELECT entity, count(*) AS total_checks, count(CASE WHEN passed THEN 1 END) AS passed_checks,
  count(CASE WHEN NOT passed THEN 1 END) AS failed_checks,
  count(CASE WHEN NOT passed THEN 1 END) = 0 AS success
FROM ({" UNION ALL ".join(_suite_sql(e) for e in ENTITIES)}) r GROUP BY entity""")(
    lambda m: quality.summarize(quality.validate_all({e: getattr(m.raw, e) for e in ENTITIES})))

# Freshness of each raw table at a given instant.
def fresh_sql(e: str, now: str = NOW_FRESH) -> str:
    col = "extracted_at" if e in ("predictions", "vehicles", "alerts") else "timestamp"
    lim = {"predictions": "0.5", "vehicles": "0.5", "alerts": "25.0", "weather": "25.0", "routes": "25.0",
           "stops": "25.0"}[e]
    newest = f"max(TIMESTAMP '{LANDED_AT}')" if e in ("routes", "stops") else f'max("{col}")'
    age = f"((epoch_us(TIMESTAMP '{now}') // 1000000) - (epoch_us({newest}) // 1000000)) / 3600.0::DOUBLE"
    return (f"SELECT '{e}' AS entity, 'freshness' AS check, coalesce({age} <= {lim}, FALSE) AS passed, "
            f"'<= {lim} h' AS expected, coalesce(CAST({rnd(age, 2)} AS VARCHAR), 'missing') AS actual, "
            f"CAST(NULL AS VARCHAR) AS details FROM raw_{e}")


_FRESH = ("routes", "stops", "predictions", "vehicles", "alerts", "weather")


def _stamped(m, e: str):
    df = getattr(m.raw, e)
    return df.withColumn("extracted_at", F.lit(LANDED_AT).cast("timestamp")) if e in ("routes", "stops") else df


register("p9_freshness", "\nUNION ALL ".join(fresh_sql(e) for e in _FRESH))(
    lambda m: quality.freshness({e: _stamped(m, e) for e in _FRESH}, NOW_FRESH))


def p9b_file_freshness(spark, sf_dir):
    """Routes and stops hold no instant of their own: their age is that of the files they come from."""
    out = history.file_freshness(spark, {"routes": f"{sf_dir}/nation.parquet", "stops": f"{sf_dir}/supplier.parquet"})
    return out.drop("actual")


register_raw("p9b_file_freshness")(p9b_file_freshness)


# Schema tests on the staging models.
def _schema_sql(tests=quality.STAGING_TESTS) -> str:
    parts = []
    for name, t in tests.items():
        for c in t.not_null:
            parts.append(f"SELECT '{name}' AS model, 'not_null:{c}' AS test, count(CASE WHEN {c} IS NULL THEN 1 END) AS failures, 'error' AS severity FROM {name}")
        for c, vals in t.accepted.items():
            parts.append(f"SELECT '{name}', 'accepted_values:{c}', count(CASE WHEN {c} IS NOT NULL AND {c} NOT IN ({', '.join(map(str, vals))}) THEN 1 END), 'error' FROM {name}")
        for c in t.unique:
            parts.append(f"SELECT '{name}', 'unique:{c}', count(*), 'error' FROM (SELECT {c} FROM {name} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1) d")
        for c, parent, pc in t.relationships:
            parts.append(f"SELECT '{name}', 'relationships:{c}->{parent}.{pc}', count(*), 'warn' FROM {name} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pc} = x.{c})")
    return ("SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM (\n"
            + "\nUNION ALL ".join(parts) + ") t")


register("p11_schema_tests_staging", _schema_sql())(
    lambda m: quality.schema_tests({n: getattr(m, n) for n in quality.STAGING_TESTS}, quality.STAGING_TESTS))


_INNER = {"int_scheduled_vs_actual": "scheduled_vs_actual", "int_stop_activity": "stop_activity",
          "int_alert_impacts": "alert_impacts", "int_weather_transit": "weather_transit"}


def _model(m, name: str):
    if name.startswith("raw_"):
        return getattr(m.raw, name.removeprefix("raw_"))
    return getattr(m, _INNER.get(name, name.removeprefix("mart_")))


register("p11b_schema_tests_models", _schema_sql(quality.MODEL_TESTS))(
    lambda m: quality.schema_tests({n: _model(m, n) for n in quality.MODEL_TESTS}, quality.MODEL_TESTS))
register("p11c_schema_tests_sources", _schema_sql(quality.SOURCE_TESTS).replace(
    "not_null:timestamp' AS test, count(CASE WHEN timestamp IS NULL", "not_null:timestamp' AS test, count(CASE WHEN \"timestamp\" IS NULL"))(
    lambda m: quality.schema_tests({n: _model(m, n) for n in quality.SOURCE_TESTS}, quality.SOURCE_TESTS))


# P10: warehouse minimum rows over the table statistics.
register("p10_warehouse_min_rows", "SELECT t.table_name, coalesce(c.row_count, 0) AS row_count, t.min_rows, "
         "coalesce(c.row_count, 0) >= t.min_rows AS passed FROM (VALUES "
         + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in quality.WAREHOUSE_MIN_ROWS.items())
         + ") t(table_name, min_rows) LEFT JOIN (" + "\nUNION ALL ".join(
             f"SELECT 'raw_{e}' AS table_name, count(*) AS row_count FROM raw_{e}" for e in ENTITIES)
         + ") c ON c.table_name = t.table_name")(
    lambda m: quality.minimum_rows(_stats(m), quality.WAREHOUSE_MIN_ROWS))

# Checks the source design declares — no snapshot instant after "now",
# delays inside the accepted window.
NOW_P14 = "1998-01-01 00:00:00"
_P14_TS = ("predictions", "vehicles", "alerts")


def _future_sql(e: str) -> str:
    bad = f"count(CASE WHEN CAST(extracted_at AS TIMESTAMP) > TIMESTAMP '{NOW_P14}' THEN 1 END)"
    return (f"SELECT '{e}' AS entity, 'no_future:extracted_at' AS \"check\", {bad} = 0 AS passed, "
            f"'0' AS expected, CAST({bad} AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS details FROM raw_{e}")


def _future(m):
    out = None
    for e in _P14_TS:
        r = quality.no_future_timestamps(getattr(m.raw, e), e, ["extracted_at"], NOW_P14)
        out = r if out is None else out.unionByName(r)
    return out


register("p14_no_future_timestamps", "\nUNION ALL ".join(_future_sql(e) for e in _P14_TS))(_future)
# The delays as they are before the model drops those out of range.
_DELAYS_SQL = CTES["int_scheduled_vs_actual"].replace("WHERE l.delay_seconds BETWEEN -1800 AND 3600",
                                                     "WHERE l.delay_seconds IS NOT NULL")


def _all_delays(m):
    return intermediate.scheduled_vs_actual(m.stg_predictions, m.stg_schedules, m.stg_routes, m.stg_stops, m.tz,
                                            in_range=False)


register("p14b_delay_range", f"""
SELECT 'delays' AS entity, 'valid_delay_range:delay_seconds' AS "check", bad = 0 AS passed,
  '[-1800, 3600]' AS expected, CAST(bad AS VARCHAR) AS actual, CAST(NULL AS VARCHAR) AS details
FROM (SELECT count(*) FILTER (delay_seconds < -1800 OR delay_seconds > 3600) AS bad FROM ({_DELAYS_SQL}) l) x""")(
    lambda m: quality.delay_in_range(_all_delays(m)))

_DRIFT = {"predictions": ["prediction_id", "stop_id", "arrival_time", "departure_time", "status"],
          "vehicles": ["vehicle_id", "stop_id", "trip_id"]}
#: The snapshots that the first of the two recorded runs sees.
DRIFT_CUT = "2000-01-01 00:00:00"


def _drift_sql() -> str:
    parts = []
    for t, cols in _DRIFT.items():
        old = f"CAST(extracted_at AS TIMESTAMP) < TIMESTAMP '{DRIFT_CUT}'"
        parts.append(f"SELECT '{t}' AS table_name, 'rows' AS metric, count(*) AS value, count(*) FILTER ({old}) AS previous FROM raw_{t}")
        parts += [f"SELECT '{t}', 'nulls:{c}', count(*) FILTER ({c} IS NULL), count(*) FILTER ({c} IS NULL AND {old}) FROM raw_{t}"
                  for c in cols]
    change = "CASE WHEN previous > 0 THEN (value - previous) * 100.0::DOUBLE / previous END"
    return (f"SELECT table_name, metric, value, previous, {rnd(change, 1)} AS change_pct, "
            f"NOT (metric = 'rows' AND value = 0) AND coalesce(abs({change}) <= 50, TRUE) AS passed FROM ("
            + "\nUNION ALL ".join(parts) + ") s")


def p14c_drift(m):
    """Statistics of two landed snapshots, kept run by run and compared."""
    kept = history.StatsHistory(m.spark, f"{checkpoint_dir(m.spark).rstrip('/')}/stats-{uuid.uuid4().hex[:8]}")
    tables = {t: getattr(m.raw, t).select("extracted_at", *cols) for t, cols in _DRIFT.items()}
    cut = F.col("extracted_at").cast("timestamp") < F.lit(DRIFT_CUT).cast("timestamp")
    kept.record({t: df.filter(cut).drop("extracted_at") for t, df in tables.items()}, 1)
    kept.record({t: df.drop("extracted_at") for t, df in tables.items()}, 2)
    return kept.drift()


register("p14c_statistics_drift", _drift_sql())(p14c_drift)
