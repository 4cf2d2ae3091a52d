"""Regressions: late and replayed positions, failed renames, type widening, shared folders, metric ranges."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake import session
from transitlake.operators import loads, quality
from transitlake.operators.loads import RawStore
from transitlake.plans import learning, staging
from transitlake.plans.intermediate import stop_activity
from transitlake.plans.queries import schedules
from transitlake.sources import schemas as S
from transitlake.sources.proxy import RawTables
from transitlake.streaming import jobs as sj
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("unit", ["day", "month"])
def test_stop_activity_counts_late_rows_and_replays_once(spark, tmpdir_path, unit):
    raw = RawTables(spark, SF_SMALL)
    folders = [sj.land_in_time_order(raw.vehicles, f"{tmpdir_path}/land-{i}", "extracted_at", 3, newest_first=True)
               for i in range(2)]
    stream = sj.ingest_stream(spark, folders, raw.vehicles.schema)
    store = RawStore(spark, f"{tmpdir_path}/store", unit=unit)
    sj.stop_activity_stream(stream, store, raw.stops, raw.routes, f"{tmpdir_path}/log", f"{tmpdir_path}/ck")
    keys = ["stop_id", "route_id", "activity_hour", "direction_id"]
    got = sj.read_current(spark, f"{tmpdir_path}/log", keys)
    want = stop_activity(staging.stg_vehicles(raw.vehicles), staging.stg_stops(raw.stops),
                         staging.stg_routes(raw.routes)).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _routes(spark, n):
    rows = [tuple({"route_id": f"r{i}"}.get(f.name) for f in S.ROUTES.fields) for i in range(n)]
    return spark.createDataFrame(rows, S.ROUTES)


def test_failed_rename_keeps_the_table(spark, tmpdir_path):
    store = RawStore(spark, tmpdir_path)
    assert store.load("routes", _routes(spark, 2)) == 2
    with pytest.raises(FileNotFoundError):
        store._swap(f"{tmpdir_path}/missing", store.table_path("routes"))
    assert store.table("routes").count() == 2

    class Stubborn:
        """A file system that answers false when the new folder is moved."""

        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".new-" in str(a.toString()) else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    real = store._fs
    store._fs = lambda path: (Stubborn(real(path)[0]), real(path)[1])
    with pytest.raises(OSError):
        store.load("routes", _routes(spark, 5))
    store._fs = real
    assert store.table("routes").count() == 2


def test_union_relaxed_has_a_type_for_all(spark):
    out = loads.union_relaxed([spark.createDataFrame([(1, 5)], "a int, b int"),
                               spark.createDataFrame([("x1", 2.5)], "a string, b float")])
    assert out.schema["a"].dataType == T.StringType() and out.schema["b"].dataType == T.DoubleType()
    assert {(r.a, r.b) for r in out.collect()} == {("1", 5.0), ("x1", 2.5)}
    pairs = [(T.LongType(), T.FloatType(), T.DoubleType()), (T.ShortType(), T.IntegerType(), T.IntegerType()),
             (T.DecimalType(5, 2), T.IntegerType(), T.DecimalType(12, 2)),
             (T.DateType(), T.TimestampType(), T.TimestampType()), (T.BooleanType(), T.LongType(), T.StringType()),
             (T.NullType(), T.DateType(), T.DateType())]
    for a, b, want in pairs:
        assert loads.common_type(a, b) == want == loads.common_type(b, a)


def test_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda k, d=None: None)
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="shared folder"):
        session.checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_regression_metrics_do_not_overflow(spark):
    pred = spark.range(5_000_000).select(F.lit(1000).alias("target_delay_seconds"), F.lit(1000.0).alias("prediction"))
    pred = pred.unionByName(spark.createDataFrame([(2000, 1900.0)], "target_delay_seconds int, prediction double"))
    r = learning.regression_metrics(pred).first()
    assert r["n"] == 5_000_001 and r["r2"] == pytest.approx(1 - 100**2 / (1000**2 * (1 - 1 / 5_000_001)), abs=1e-4)
    assert learning.residual_stats(pred).first()["median_residual"] == 0


def test_curves_do_not_depend_on_exchange_reuse(spark):
    pred = spark.range(20_000).select(((F.col("id") * 7919) % 20_011 / 20_011.0).alias("probability_late"),
                                      (F.col("id") % 3 == 0).cast("int").alias("target_is_late"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = learning.score_prefix_sums(pred).orderBy(F.desc("threshold")).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    tp = fp = 0
    for r in rows:
        tp, fp = tp + r["pos"], fp + r["neg"]
        assert (r["tp"], r["fp"]) == (tp, fp)


def test_freshness_limits(spark):
    at = dt.datetime(2025, 6, 20, 12)
    df = spark.createDataFrame([(at,)], "extracted_at timestamp")
    names = ("routes", "stops", "predictions", "vehicles", "alerts", "weather")
    got = {r.entity: r.passed for r in quality.freshness(dict.fromkeys(names, df), "2025-06-20 22:00:00").collect()}
    assert got == {n: n not in ("predictions", "vehicles") for n in names}


def test_schedule_window_reaches_the_scan(spark, tmpdir_path):
    path = f"{tmpdir_path}/s"
    spark.createDataFrame([(dt.datetime(2025, 1, d),) for d in range(1, 20)], "departure_time timestamp") \
        .write.parquet(path)
    s = schedules._with_service_date(spark.read.parquet(path), "UTC")
    out = schedules._window(s, "2025-01-05", "2025-01-06")
    assert out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(departure_time" in plan
