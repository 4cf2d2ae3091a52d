"""What crosses a shuffle or is written: each row once, in the columns that are needed."""

import glob
import re

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from transitlake.operators.latest import dedupe_on, latest_per_key
from transitlake.plans import features as FE
from transitlake.plans.incremental import DelayTable, Tables
from transitlake.plans.models import Models
from transitlake.session import checkpoint_dir
from transitlake.sources.proxy import RawTables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_by(df, *keys) -> int:
    cols = ", ".join(rf"{k}#\d+L?" for k in keys)
    return len(re.findall(rf"Exchange hashpartitioning\({cols}, ", plan(df)))


def test_latest_rows_are_not_shuffled_again_for_a_join_on_their_keys(spark):
    rows = spark.range(100).selectExpr("id % 7 AS k", "id AS v", "id % 3 AS o")
    other = spark.range(7).selectExpr("id AS k", "id AS w")
    j = latest_per_key(rows, ["k"], ["o", "v"]).join(other.hint("merge"), "k")
    assert shuffles_by(j, "k") <= 2 and plan(j).count("Exchange") <= 2


def test_latest_row_with_nulls_computed_order_and_ties(spark):
    rows = spark.createDataFrame([("a", None, 1, "x"), ("a", 2, None, "y"), ("a", 2, None, "z"), (None, 5, 5, "n"),
                                  (None, None, 9, "m"), ("b", None, None, None)], "k string, o int, p int, v string")
    got = {r.k: tuple(r) for r in latest_per_key(rows, ["k"], ["o"]).collect()}
    assert got == {"a": ("a", 2, None, "z"), None: (None, 5, 5, "n"), "b": ("b", None, None, None)}
    got = {r.k: tuple(r) for r in latest_per_key(rows, ["k"], [F.coalesce("o", "p"), "k", "v"]).collect()}
    assert got == {"a": ("a", 2, None, "z"), None: (None, None, 9, "m"), "b": ("b", None, None, None)}
    assert dedupe_on(rows, ["k", "o", "p", "v"]).count() == 6


def test_delays_shuffle_the_latest_predictions_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffles_by(Models(RawTables(spark, SF_SMALL)).scheduled_vs_actual, "trip_id", "stop_id", r"\w+") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feature_matrix_computes_the_delays_once(spark):
    fm = FE.feature_matrix(Models(RawTables(spark, SF_SMALL)))
    # The visits are read for the hours of the weather, not for the rows or their histories.
    assert "max(struct(" not in plan(fm) and len(re.findall(r"lineitem\.parquet", plan(fm))) <= 1


def test_a_refresh_writes_the_periods_once(spark, tmpdir_path):
    raw = RawTables(spark, SF_SMALL)
    late = F.col("extracted_at").cast("timestamp") >= F.lit("2001-09-01").cast("timestamp")
    table = DelayTable(spark, f"{tmpdir_path}/e1", unit="month")
    table.build(Models(Tables(raw, predictions=raw.predictions.filter(~late))))
    kept = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/**/rdd-*", recursive=True))
    full = Models(raw)
    assert table.refresh(full, table.touched(raw.predictions.filter(late))) > 0
    assert set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/**/rdd-*", recursive=True)) == kept
    assert not glob.glob(f"{tmpdir_path}/e1.new-*")
    assert table.rows().exceptAll(full.scheduled_vs_actual).isEmpty() and table.rows().count() == full.scheduled_vs_actual.count()


def test_landed_documents_are_compressed(spark):
    from transitlake.plans.catalog_sources import docs_roundtrip
    rows = docs_roundtrip(spark, SF_SMALL, "predictions")
    assert rows.inputFiles() and all(f.endswith(".gz") for f in rows.inputFiles())
    assert rows.count() == RawTables(spark, SF_SMALL).predictions.count()


def test_rides_lie_by_trip_and_route_for_the_legs(spark):
    from transitlake.plans.catalog_pairs import MAX_WAIT, stop_pairs
    from transitlake.plans.queries import trip_pairs as qp
    m = Models(RawTables(spark, SF_SMALL))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        options = qp.pair_options(m, stop_pairs(m), feasible=True, max_wait=MAX_WAIT)
        assert shuffles_by(options, "trip_id", "route_id", "direction_id") == 0
        # Arrivals and departures become three events each only after they are dealt out by cell.
        text = plan(options)
        assert text.index("Generate explode") < text.index("REPARTITION_BY_COL")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
