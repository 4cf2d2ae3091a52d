"""Load rules (FIXTURES §3: replace, append, idempotency, snapshots, de-dup)."""

import pytest
from pyspark.sql import functions as F

from transitlake.operators import loads
from transitlake.operators.loads import RawStore
from transitlake.sources import schemas as S


def routes(spark, ids):
    rows = [tuple([i, f"Route {i}"] + [None] * (len(S.ROUTES.fields) - 2)) for i in ids]
    return spark.createDataFrame(rows, S.ROUTES)


def preds(spark, rows):
    """rows: (prediction_id, extracted_at, arrival_time)"""
    full = []
    for pid, ts, arr in rows:
        r = {f.name: None for f in S.PREDICTIONS.fields}
        r.update(prediction_id=pid, extracted_at=ts, arrival_time=arr)
        full.append(tuple(r[f.name] for f in S.PREDICTIONS.fields))
    return spark.createDataFrame(full, S.PREDICTIONS)


def test_replace_load_twice(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    assert st.load("routes", routes(spark, ["1", "2"])) == 2
    assert st.load("routes", routes(spark, ["1", "2"])) == 2


def test_append_over_batches_and_idempotent_replay(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", "2025-06-20T14:00:00Z", "x"), ("p2", "2025-06-20T14:00:00Z", "y")])
    b = preds(spark, [("p3", "2025-06-20T15:00:00Z", "z")])
    assert st.load("predictions", a) == 2
    assert st.load("predictions", b) == 3
    assert st.load("predictions", a) == 3          # same file again: nothing added
    assert st.load("predictions", a.unionByName(b)) == 3


def test_new_snapshot_is_new_rows(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", "2025-06-20T14:00:00Z", "x"), ("p2", "2025-06-20T14:00:00Z", "y")])
    later = a.withColumn("extracted_at", F.lit("2025-06-20T14:05:00Z"))
    st.load("predictions", a)
    assert st.load("predictions", later) == 4


def test_in_file_key_collision_keeps_one(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", "2025-06-20T14:00:00Z", "x"), ("p1", "2025-06-20T14:00:00Z", "y")])
    assert st.load("predictions", a) == 1
    dup = st.table("predictions").groupBy("prediction_id", "extracted_at").count().filter("count > 1")
    assert dup.count() == 0


def test_null_keys_not_reinserted(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", None, "x")])
    assert st.load("predictions", a) == 1
    assert st.load("predictions", a) == 1


def test_dedupe_existing(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    rows = preds(spark, [("p1", "t1", "a"), ("p1", "t1", "b"), ("p2", "t1", "c")])
    rows.write.parquet(st.table_path("predictions"))
    assert st.dedupe("predictions") == 2
    assert st.dedupe("routes") == 0                 # absent table


def test_column_intersection_and_errors(spark):
    tgt = preds(spark, [("p1", "t1", "a")])
    src = spark.createDataFrame([("p2", "t2", "extra")], "prediction_id string, extracted_at string, junk string")
    out = loads.new_rows(tgt, src, ["prediction_id", "extracted_at"])
    assert out.columns == tgt.columns and out.count() == 1
    with pytest.raises(ValueError):
        loads.new_rows(tgt, spark.createDataFrame([(1,)], "zzz int"), ["prediction_id"])


def test_unknown_entity(spark, tmpdir_path):
    with pytest.raises(ValueError, match="Unknown entity"):
        RawStore(spark, tmpdir_path).load("nonexistent", routes(spark, ["1"]))


def test_load_all_and_stats(spark, tmpdir_path):
    land = f"{tmpdir_path}/landing"
    routes(spark, ["1", "2"]).write.parquet(f"{land}/routes/dt=2025-06-20")
    preds(spark, [("p1", "t1", "a"), ("p2", "t1", "b"), ("p3", "t2", "c")]).write.parquet(
        f"{land}/predictions/dt=2025-06-20/hr=14")
    st = RawStore(spark, f"{tmpdir_path}/wh")
    rep = {r["entity"]: r["row_count"] for r in st.load_all(land).collect()}
    assert rep["routes"] == 2 and rep["predictions"] == 3 and rep["stops"] == 0
    stats = {r["table_name"]: r["row_count"] for r in st.stats().collect()}
    assert stats == {"raw_routes": 2, "raw_predictions": 3}


def test_landing_partition_paths(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    df = preds(spark, [("p1", None, "a")])
    st.land("predictions", df, f"{tmpdir_path}/landing", extracted_at="2025-06-20T14:30:00+00:00")
    st.land("predictions", df, f"{tmpdir_path}/landing", extracted_at="2025-06-20T00:05:00+00:00")
    st.land("routes", routes(spark, ["1"]), f"{tmpdir_path}/landing", extracted_at="2025-06-20T00:05:00+00:00")
    import os
    assert os.path.isdir(f"{tmpdir_path}/landing/predictions/dt=2025-06-20/hr=14")
    assert os.path.isdir(f"{tmpdir_path}/landing/predictions/dt=2025-06-20/hr=00")
    assert os.path.isdir(f"{tmpdir_path}/landing/routes/dt=2025-06-20")


def test_union_relaxed(spark):
    a = spark.createDataFrame([(1, "x")], "v int, s string")
    b = spark.createDataFrame([(2.5,)], "v double")
    out = loads.union_relaxed([a, b])
    assert dict(out.dtypes)["v"] == "double" and out.count() == 2


def test_empty_first_batch_is_a_noop(spark, tmpdir_path):
    """An empty batch before any data creates no table; the next batch loads."""
    from transitlake.operators.loads import RawStore
    from transitlake.sources import schemas as S
    store = RawStore(spark, f"{tmpdir_path}/wh")
    assert store.load("vehicles", spark.createDataFrame([], S.VEHICLES)) == 0
    assert not store.exists("vehicles")
    row = tuple({"vehicle_id": "v1", "extracted_at": "2025-06-20T12:00:00Z"}.get(f.name) for f in S.VEHICLES.fields)
    assert store.load("vehicles", spark.createDataFrame([row], S.VEHICLES)) == 1
