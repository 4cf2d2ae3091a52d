"""Merge with keys, ad-hoc SQL, databases of layers, tree copies, status labels."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tests.test_loads import preds, routes
from transitlake.functions.labels import delay_status
from transitlake.operators import loads, tables, trees
from transitlake.operators.loads import RawStore
from transitlake.plans import staging
from transitlake.plans.models import Models
from transitlake.sources import landed


def test_merge_inserts_unseen_keys_only(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", "2025-06-20T14:00:00Z", "x"), ("p1", "2025-06-20T14:00:00Z", "y")])
    b = preds(spark, [("p1", "2025-06-20T14:00:00Z", "z"), ("p2", "2025-06-20T15:00:00Z", "w")])
    assert st.merge("predictions", a) == 1
    assert st.merge("predictions", b) == st.merge("predictions", b) == 2
    assert {r.prediction_id: r.arrival_time for r in st.rows("predictions").collect()} == {"p1": "y", "p2": "w"}
    assert not glob.glob(f"{tmpdir_path}/*.stage-*")


def test_merge_without_a_key_is_an_error(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    a = preds(spark, [("p1", "2025-06-20T14:00:00Z", "x")])
    st.merge("predictions", a)
    with pytest.raises(ValueError, match="prediction_id"):
        st.merge("predictions", a.drop("prediction_id"))
    with pytest.raises(ValueError, match="no key"):
        st.merge("routes", routes(spark, ["1"]).drop("route_id"))
    assert st.rows("predictions").count() == 1 and not glob.glob(f"{tmpdir_path}/*.stage-*")


def test_sql_over_the_store(spark, tmpdir_path):
    st = RawStore(spark, tmpdir_path)
    st.load("routes", routes(spark, ["1", "2"]))
    st.load("predictions", preds(spark, [("p1", "2025-06-20T14:00:00Z", "x")]))
    got = st.sql("SELECT count(*) AS n FROM raw_routes UNION ALL SELECT count(*) FROM raw_predictions").collect()
    assert sorted(r.n for r in got) == [1, 2]
    assert not spark.catalog.tableExists("raw_routes")


def test_databases_of_the_layers(spark, tmpdir_path):
    assert [tables.database_of(m) for m in ("stg_routes", "int_delays", "mart_x", "other")] == [
        "staging", "intermediate", "marts", "default"]
    assert tables.database_of("stg_routes", "dev", {"stg": " "}) == "dev"
    name = tables.publish(spark.range(3), "mart_three", tmpdir_path, layers={"mart": "marts_of_test"})
    assert name == "marts_of_test.mart_three" and spark.table(name).count() == 3
    tables.publish(spark.range(5), "mart_three", tmpdir_path, layers={"mart": "marts_of_test"})
    assert spark.table(name).count() == 5
    spark.sql("DROP DATABASE marts_of_test CASCADE")


def test_a_killed_copy_goes_on(spark, tmpdir_path):
    src, dst = f"{tmpdir_path}/from", f"{tmpdir_path}/to"
    spark.range(40).withColumn("dt", F.col("id") % 4).repartition(2).write.partitionBy("dt").parquet(src)
    names = sorted(os.path.relpath(f, src) for f in glob.glob(f"{src}/*/*.parquet"))
    # What a killed run leaves: a whole file, half a file, and one under its temporary name.
    for i, name in enumerate(names[:3]):
        os.makedirs(os.path.dirname(f"{dst}/{name}"), exist_ok=True)
        data = open(f"{src}/{name}", "rb").read()
        left = os.path.join(os.path.dirname(name), "_part-0-" + os.path.basename(name)) if i == 2 else name
        open(f"{dst}/{left}", "wb").write(data if i == 0 else data[:50])
    stamp = os.path.getmtime(f"{dst}/{names[0]}")
    assert trees.copy_tree(spark, src, dst, tasks=3) == len(names) - 1
    assert sorted(os.path.relpath(f, dst) for f in glob.glob(f"{dst}/*/part-*.parquet")) == names
    assert all(open(f"{src}/{n}", "rb").read() == open(f"{dst}/{n}", "rb").read() for n in names)
    assert os.path.getmtime(f"{dst}/{names[0]}") == stamp
    assert trees.copy_tree(spark, src, dst) == 0
    assert spark.read.parquet(dst).count() == 40
    assert trees.copy_tree(spark, f"{tmpdir_path}/none", dst) == 0


def test_delay_status(spark):
    rows = spark.createDataFrame([(0.0,), (0.04,), (-0.04,), (0.05,), (-3.25,), (12.0,), (None,)], "m double")
    got = [(r[0], r[1]) for r in rows.select(delay_status("m"), delay_status("m", compact=True)).collect()]
    assert got[:6] == [("0.0 min on time", "0.0 on time"), ("0.0 min on time", "0.0 on time"),
                       ("0.0 min on time", "0.0 on time"), ("0.1 min delayed", "0.1 delayed"),
                       ("3.3 min early", "3.3 early"), ("12.0 min delayed", "12.0 delayed")]


def test_a_seed_with_other_columns_is_an_error(spark, tmpdir_path):
    good, bad = f"{tmpdir_path}/good", f"{tmpdir_path}/bad"
    seed = landed.route_type_seed(spark)
    seed.write.option("header", True).csv(good)
    seed.withColumnRenamed("route_type_name", "label").write.option("header", True).csv(bad)
    assert sorted(landed.read_seed(spark, good).collect()) == sorted(seed.collect())
    with pytest.raises(Exception, match="header"):
        landed.read_seed(spark, bad).collect()


def test_a_declared_schema_reads_files_of_any_columns(spark, tmpdir_path):
    spark.range(2).selectExpr("cast(id as string) route_id", "'x' long_name").write.parquet(f"{tmpdir_path}/in/a")
    spark.range(1).selectExpr("'9' route_id", "'y' other").write.parquet(f"{tmpdir_path}/in/b")
    st = RawStore(spark, f"{tmpdir_path}/store")
    assert st.load_path("routes", f"{tmpdir_path}/in", declared=True) == 3
    rows = st.rows("routes")
    assert "other" not in rows.columns and {r.route_id: r.long_name for r in rows.collect()} == {
        "0": "x", "1": "x", "9": None}


def test_route_report_fills_gaps(spark):
    df = spark.createDataFrame([("1", None, None, None, -0.25, None), ("2", "", "Bus", 99.96, 1.0, 7)],
                               "route_id string, route_name string, route_type_desc string, on_time_pct double, "
                               "avg_delay_minutes double, total_predictions long")
    got = [tuple(r) for r in loads.route_report(df).collect()]
    assert got == [("1", "1", "", "0.0", "-0.3", "0"), ("2", "2", "Bus", "100.0", "1.0", "7")]


def test_marts_read_narrow_predictions(spark):
    m = Models.from_dir(spark, "/root/testdata/sf0.001")
    narrow = m._mart_delays
    assert not {"status", "revenue", "vehicle_id"} & set(narrow.columns)
    assert narrow.exceptAll(m.scheduled_vs_actual.select(*narrow.columns)).isEmpty()
    cols = ["trip_id", "stop_id", "extracted_at"]
    assert staging.stg_predictions(m.raw.predictions, cols).exceptAll(m.stg_predictions.select(*cols)).isEmpty()
