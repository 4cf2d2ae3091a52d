"""Upsert tables, incremental delays, leak-free features, drift, freshness, sketches, pruned stream joins."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from transitlake.operators import history, quality, sketches
from transitlake.operators.upserts import UpsertTable
from transitlake.plans import features as FE
from transitlake.plans import intermediate
from transitlake.plans.incremental import DelayTable, Tables
from transitlake.plans.models import Models
from transitlake.sources.proxy import RawTables
from transitlake.streaming import jobs as sj

SF = "/root/testdata/sf0.001"
ROW = "k string, day date, at int, v string"


def _batch(spark, rows):
    return spark.createDataFrame([(k, dt.date(2025, 1, d), at, v) for k, d, at, v in rows], ROW)


def _table(spark, path, **kw):
    return UpsertTable(spark, path, spark.createDataFrame([], ROW).schema, ["k", "day"], ["at", "v"], **kw)


def _files(path, part=""):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/base/**/{part}*.parquet", recursive=True)}


def test_upsert_table_stays_flat(spark, tmpdir_path):
    t = _table(spark, tmpdir_path, buckets=3, log_limit=4)
    want, sizes = {}, []
    for n in range(20):
        rows = [(f"k{(n + i) % 7}", 1, 100 * n + i if i % 3 else i, f"v{n}.{i}") for i in range(10)]
        t.upsert(_batch(spark, rows), n)
        for k, d, at, v in rows:
            want[k] = max(want.get(k, (-1, "")), (at, v))
        sizes.append((len(t.pending()), len(glob.glob(f"{tmpdir_path}/**/*.parquet", recursive=True))))
        if n % 6 == 5:
            assert {r.k: (r["at"], r.v) for r in t.rows().collect()} == want
    assert {r.k: (r["at"], r.v) for r in t.rows().collect()} == want and t.rows().count() == 7
    assert max(p for p, _ in sizes) < 4 and max(f for _, f in sizes[12:]) <= max(f for _, f in sizes[4:12])
    # A batch that comes again after compaction changes nothing; a late, older row never wins.
    t.upsert(_batch(spark, [("k0", 1, 10_000, "again")]), 3)
    t.upsert(_batch(spark, [("k0", 1, -5, "late")]), 20)
    t.compact()
    assert {r.k: (r["at"], r.v) for r in t.rows().collect()} == want
    assert t.compact() == 0


def test_days_that_no_row_reaches_are_sealed(spark, tmpdir_path):
    t = _table(spark, tmpdir_path, part=F.col("day"), log_limit=1)
    t.upsert(_batch(spark, [("a", d, 1, "x") for d in (1, 2, 3)]), 0)
    old = _files(tmpdir_path)
    t.upsert(_batch(spark, [("a", 3, 2, "y"), ("b", 4, 2, "y")]), 1)
    t.upsert(_batch(spark, [("a", 2, 0, "late")]), 2)
    now = _files(tmpdir_path)
    kept = [f for f in old if "day" not in f and "=2025-01-01" in f]
    assert kept and all(now[f] == old[f] for f in kept)
    got = {(r.k, r.day.day): r.v for r in t.rows().collect()}
    assert got == {("a", 1): "x", ("a", 2): "x", ("a", 3): "y", ("b", 4): "y"}


def test_empty_table_and_null_parts(spark, tmpdir_path):
    t = _table(spark, tmpdir_path, part=F.col("day"))
    assert t.rows().collect() == [] and t.compact() == 0 and t.pending() == []
    t.upsert(spark.createDataFrame([("a", None, 1, "x"), ("a", None, 2, "y")], ROW), 0)
    t.compact()
    assert [tuple(r) for r in t.rows().collect()] == [("a", None, 2, "y")]


def test_a_refresh_writes_only_what_a_batch_touches(spark, tmpdir_path):
    raw = RawTables(spark, SF)
    p = raw.predictions
    late = F.col("extracted_at").cast("timestamp") >= F.lit("2001-09-01").cast("timestamp")
    table = DelayTable(spark, f"{tmpdir_path}/e1", unit="month")
    table.build(Models(Tables(raw, predictions=p.filter(~late))))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{tmpdir_path}/e1/*/*.parquet")}
    batch = p.filter(late)
    touched = table.touched(batch)
    full = Models(raw)
    assert 0 < table.refresh(full, touched) < len(glob.glob(f"{tmpdir_path}/e1/period=*")) + 1
    assert table.rows().exceptAll(full.scheduled_vs_actual).count() == 0
    assert full.scheduled_vs_actual.exceptAll(table.rows()).count() == 0
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{tmpdir_path}/e1/*/*.parquet")}
    names = {f"period={d}" for d in touched}
    untouched = [f for f in before if f.split("/")[-2] not in names]
    assert untouched and all(after.get(f) == before[f] for f in untouched)
    assert table.refresh(full, []) == 0


def test_a_moved_row_leaves_its_old_period(spark, tmpdir_path):
    raw = RawTables(spark, SF)
    one = Models(raw).scheduled_vs_actual.limit(1).collect()[0]
    mine = (F.col("trip_id") == one.trip_id) & (F.col("stop_id") == one.stop_id)
    p = raw.predictions.filter(mine)
    table = DelayTable(spark, f"{tmpdir_path}/e1").build(Models(Tables(raw, predictions=p)))
    assert table.rows().count() == 1
    # A newer snapshot of the same trip and stop ten years on, where no schedule lies.
    far = F.expr("INTERVAL 3650 DAYS")
    newer = p.withColumns({c: F.col(c) + far for c in ("arrival_time", "departure_time", "extracted_at")})
    both = Models(Tables(raw, predictions=p.unionByName(newer)))
    table.refresh(both, table.touched(newer))
    assert glob.glob(f"{tmpdir_path}/e1/period=*") == []


@pytest.fixture(scope="module")
def delays(spark):
    cols = ["prediction_id", "trip_id", "stop_id", "route_id", "delay_seconds", "is_late", "extracted_at"]
    m = Models(RawTables(spark, SF))
    return m.scheduled_vs_actual.select(*cols).withColumn("fold", FE.fold_of(5)).cache()


def test_no_row_moves_its_own_features(delays):
    names = ("a", "b", "c")
    base = {(r.route_id, r.fold): (r.a, r.b, r.c) for r in FE.train_history(delays, "route_id", names).collect()}
    for fold in (0, 2):
        moved = delays.withColumn("delay_seconds", F.when(F.col("fold") == fold, 9_999).otherwise(F.col("delay_seconds")))
        got = {(r.route_id, r.fold): (r.a, r.b, r.c) for r in FE.train_history(moved, "route_id", names).collect()}
        changed = {f for (k, f) in base if got[k, f] != base[k, f]}
        # Test rows move nothing; a training fold moves all but itself.
        assert changed == (set() if fold == 0 else {0, 1, 3, 4})
    rows = delays.collect()
    for (route, fold), (mean, _, rate) in list(base.items())[:20]:
        d = [r for r in rows if r.route_id == route and r.fold not in (0, fold)]
        assert mean == pytest.approx(sum(r.delay_seconds for r in d) / len(d), abs=1e-6) if d else mean is None
        assert rate == pytest.approx(sum(r.is_late for r in d) / len(d), abs=1e-6) if d else rate is None


def test_feature_matrix_names_its_history(spark):
    m = Models(RawTables(spark, SF))
    assert FE.feature_matrix(m, fit_on="train").columns == ["fold", *FE.feature_matrix(m).columns]
    with pytest.raises(ValueError):
        FE.feature_matrix(m, fit_on="test")


def test_drift_between_runs(spark, tmpdir_path):
    h = history.StatsHistory(spark, tmpdir_path)
    row = lambda n, nulls: spark.range(n).select(F.when(F.col("id") >= nulls, F.col("id")).alias("c"))
    h.record({"t": row(100, 10), "u": row(5, 0)}, 1)
    assert all(r.passed for r in h.drift().collect())           # nothing to compare with
    h.record({"t": row(120, 40)}, 2)
    h.record({"t": row(120, 40)}, 2)                            # a repeated run replaces its own
    got = {(r.table_name, r.metric): (r.value, r.previous, r.change_pct, r.passed) for r in h.drift().collect()}
    assert got["t", "rows"] == (120, 100, 20.0, True)
    assert got["t", "nulls:c"] == (40, 10, 300.0, False)
    assert got["u", "rows"] == (0, 5, -100.0, False)
    assert h.rows().filter("run = 2").count() == 2


def test_stale_files_fail(spark, tmpdir_path):
    path = f"{tmpdir_path}/routes"
    spark.range(3).coalesce(1).write.parquet(path)
    fresh = history.file_freshness(spark, {"routes": path}).first()
    assert fresh.passed and fresh.landed_at is not None
    for f in glob.glob(f"{path}/*.parquet"):
        os.utime(f, (1_700_000_000, 1_700_000_000))
    stale = history.file_freshness(spark, {"routes": path}).first()
    assert not stale.passed and float(stale.actual) > 1000
    at = dt.datetime.fromtimestamp(1_700_000_000 + 3600, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    assert history.file_freshness(spark, {"routes": path}, at).first().actual == "1.0"


def test_delay_range_sees_what_the_model_drops(spark):
    m = Models(RawTables(spark, SF))
    every = intermediate.scheduled_vs_actual(m.stg_predictions, m.stg_schedules, m.stg_routes, m.stg_stops, in_range=False)
    bad = quality.delay_in_range(every).first()
    assert not bad["passed"] and int(bad["actual"]) == every.count() - m.scheduled_vs_actual.count() > 0


def test_merged_sketches_near_the_true_quantile(spark, tmpdir_path):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.date_add(F.lit(dt.date(2025, 1, 1)), (F.col("id") % 31).cast("int")).alias("day"),
                                      (F.xxhash64("id") % 10_000).alias("v"))
    sketches.daily(rows, ["g"], "day", "v").write.parquet(f"{tmpdir_path}/s")
    kept = spark.read.parquet(f"{tmpdir_path}/s")
    assert kept.count() == 62
    for first, last in ((None, None), (dt.date(2025, 1, 5), dt.date(2025, 1, 9))):
        part = rows.filter(F.col("day").between(first, last)) if first else rows
        for r in sketches.window(kept, ["g"], [0.05, 0.5, 0.99], "day", first, last).collect():
            own = part.filter(F.col("g") == r.g)
            assert r.n == own.count()
            assert abs(own.filter(F.col("v") <= r["quantile"]).count() / r.n - r.p) < 0.03


def test_a_batch_reads_the_schedules_of_its_range_only(spark, tmpdir_path, capsys):
    raw = RawTables(spark, SF)
    raw.schedules.write.parquet(f"{tmpdir_path}/s")
    from transitlake.plans import staging
    typed = staging.typed_predictions(raw.predictions.limit(3))
    static = sj.schedules_of(typed, spark.read.parquet(f"{tmpdir_path}/s"))
    static.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(arrival_time" in plan and "PushedFilters" in plan
    assert 0 < static.count() < raw.schedules.count()
    assert sj.schedules_of(typed.filter("false"), raw.schedules).count() == 0
