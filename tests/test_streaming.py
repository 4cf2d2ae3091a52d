"""Streaming semantics: late snapshots never win, replays add nothing."""

import datetime as dt

from pyspark.sql import functions as F

from transitlake.operators.loads import RawStore
from transitlake.streaming import jobs as sj

SCHEMA = "trip_id string, stop_id string, extracted_at timestamp, v string"


def _land(spark, path, rows, i):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_snapshot_does_not_replace_newer(spark, tmpdir_path):
    src = f"{tmpdir_path}/landing"
    t = lambda m: dt.datetime(2025, 6, 20, 12, m)
    _land(spark, src, [("t1", "s1", t(10), "new"), ("t2", "s1", t(5), "x")], 0)
    import time
    time.sleep(1.1)
    _land(spark, src, [("t1", "s1", t(0), "old-late")], 1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    sj.latest_state(stream, ["trip_id", "stop_id"], ["extracted_at", "v"], f"{tmpdir_path}/log", f"{tmpdir_path}/ck")
    cur = {r["trip_id"]: r["v"] for r in sj.read_current(spark, f"{tmpdir_path}/log", ["trip_id", "stop_id"]).collect()}
    assert cur == {"t1": "new", "t2": "x"}


def test_stream_append_replay_is_idempotent(spark, tmpdir_path):
    from transitlake.sources import schemas as S
    rows = [tuple({"vehicle_id": f"v{i}", "extracted_at": f"2025-06-20T12:0{i}:00Z"}.get(f.name)
                  for f in S.VEHICLES.fields) for i in range(3)]
    src = f"{tmpdir_path}/vehicles"
    spark.createDataFrame(rows, S.VEHICLES).write.parquet(src)
    store = RawStore(spark, f"{tmpdir_path}/wh")
    for run in (1, 2):
        s = sj.ingest_stream(spark, src, S.VEHICLES)
        sj.append_exactly_once(s, store, "vehicles", f"{tmpdir_path}/ck{run}")
    assert store.table("vehicles").count() == 3


def test_freshness_monitor(spark, tmpdir_path):
    src = f"{tmpdir_path}/p"
    spark.createDataFrame([(dt.datetime(2020, 1, 1),)], "extracted_at timestamp").write.parquet(src)
    s = spark.readStream.schema("extracted_at timestamp").parquet(src)
    sj.freshness_monitor(s, "predictions", f"{tmpdir_path}/res", f"{tmpdir_path}/ck")
    r = spark.read.parquet(f"{tmpdir_path}/res").first()
    assert r["check"] == "freshness" and r["passed"] is False
