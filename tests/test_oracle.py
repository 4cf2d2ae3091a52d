"""Registered queries vs. their DuckDB oracles on the smallest data set.

A representative subset runs by default; ``TRANSITLAKE_FULL_ORACLE=1``
runs every registered query.
"""

import os

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import check, duck

DEFAULT = ["d5_stg_predictions", "d7_stg_alerts", "e1_scheduled_vs_actual", "e2_stop_activity",
           "f1_route_reliability", "f2_stop_performance", "f3_delay_analysis", "f4_alert_summary",
           "n01_alerts_active", "n09_map_stations", "n15_overview_system_enhanced",
           "n28_stations_detail_enhanced", "n36_trip_find_routes", "n38_trip_search_stops",
           "c4_idempotent_append", "c7_merge_on_keys", "c8_dedupe_vehicles", "p8_quality_suite_raw",
           "p11_schema_tests_staging", "p14b_delay_range", "p14c_statistics_drift", "n38b_trip_search_many",
           "n36b_trip_pair_options", "o22_first_stop_pair", "e1b_incremental_delays", "q3_stream_latest_predictions",
           "q3b_stream_latest_per_service_date", "q5_stream_delay_enrichment", "r06b_leak_free_history",
           "a2_landed_hour", "a8_seed_scan", "b5_prediction_documents_to_staging", "c1_daily_landing",
           "c6_column_intersection", "c9_load_all", "c11_store_sql", "c12_copied_tree", "c15_route_report",
           "c16b_station_points", "c16c_route_line_points", "s1_sql_functions", "r08_late_distribution",
           "i06_sketched_quantiles", "m14_delay_status", "r16f_residual_formula", "r22f_pr_curve_formula"]


def _keys():
    import __spark_entry__ as E
    keys = list(E.queries())
    return keys if os.environ.get("TRANSITLAKE_FULL_ORACLE") else [k for k in keys if k in DEFAULT]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", _keys())
def test_matches_oracle(spark, con, key):
    import __spark_entry__ as E
    r = check(spark, SF_SMALL, key, E.queries()[key], E.oracle_sql().get(key), con)
    assert r["ok"] is not False, r


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "reliability_score" in df.columns


#: JSON text that the engines format differently, a composition of three
#: queries, ages of files, and the jobs that fit a model (their formulas have oracles: r..f).
ROWS_ONLY = {"c16_geojson_route_lines", "o04_trip_options", "p9b_file_freshness", "r16b_residual_statistics",
             "r17f_best_class_report", "r22b_precision_recall_curve", "r13_forest_regression", "r14_forest_classification",
             "r18_feature_importance", "r15_regression_metrics", "r15b_classification_metrics",
             "r16_best_regression_model", "r17_roc_curve", "r17b_confusion_matrix", "r19_cross_validation",
             "r20_error_by_route", "r21_classification_by_route", "r21b_classification_by_hour",
             "r22_precision_recall_summary", "r23_error_extremes", "r23b_error_by_delay_bucket", "r24_route_priority"}


def test_every_query_has_oracle_or_is_known_rows_only():
    from transitlake.plans import registry
    assert set(registry.jobs()) - set(registry.oracle()) == ROWS_ONLY
