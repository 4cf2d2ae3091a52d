"""SQL functions, P14 checks, fan-in streams, exact curves and metrics,
route finding against brute force."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from transitlake.functions.sql import register_sql_functions
from transitlake.operators import quality as Q
from transitlake.plans import learning as L


def test_sql_functions(spark):
    register_sql_functions(spark, tz="America/New_York")
    r = spark.sql("SELECT tl_service_date(timestamp'2025-06-20 06:59:00') a, tl_round(2.5, 0) b, "
                  "tl_delay_category(61) c, tl_service_seconds(timestamp'2025-06-20 05:30:00') d").first()
    assert r["a"] == dt.date(2025, 6, 19) and r["b"] == 3.0 and r["c"] == "slightly_late"
    assert r["d"] == 25 * 3600 + 1800


def test_p14_checks(spark):
    df = spark.createDataFrame([(dt.datetime(2030, 1, 1), 4000), (dt.datetime(2020, 1, 1), 10)],
                               "extracted_at timestamp, delay_seconds long")
    assert Q.no_future_timestamps(df, "predictions", ["extracted_at"], "2025-01-01 00:00:00").first()["passed"] is False
    assert Q.delay_in_range(df).first()["passed"] is False
    cur = spark.createDataFrame([("raw_routes", 100), ("raw_stops", 10)], "table_name string, row_count long")
    prev = spark.createDataFrame([("raw_routes", 90), ("raw_stops", 100)], "table_name string, row_count long")
    res = {r["table_name"]: r["passed"] for r in Q.row_count_drift(cur, prev).collect()}
    assert res == {"raw_routes": True, "raw_stops": False}


def test_fan_in_stream(spark, tmpdir_path):
    from transitlake.streaming import jobs as sj
    schema = "id string, extracted_at timestamp"
    for name, ids in (("rail", ["a", "b"]), ("bus", ["c"])):
        spark.createDataFrame([(i, dt.datetime(2025, 1, 1)) for i in ids], schema).write.parquet(f"{tmpdir_path}/{name}")
    from pyspark.sql.types import StructType, StructField, StringType, TimestampType
    st = StructType([StructField("id", StringType()), StructField("extracted_at", TimestampType())])
    s = sj.ingest_stream(spark, [f"{tmpdir_path}/rail", f"{tmpdir_path}/bus"], st, max_files_per_trigger=5)
    q = (s.writeStream.format("parquet").option("path", f"{tmpdir_path}/out")
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmpdir_path}/out").collect()) == ["a", "b", "c"]


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_exact_auc_and_ap(spark):
    scores = [0.9, 0.8, 0.8, 0.7, 0.6, 0.55, 0.5, 0.4, 0.3, 0.3, 0.2, 0.1]
    labels = [1, 1, 0, 1, 0, 1, 0, 0, 1, 0, 0, 0]
    df = spark.createDataFrame(list(zip(scores, labels)), "probability_late double, target_is_late int")
    auc = L.roc_auc(df.repartition(3)).first()["auc"]
    assert abs(auc - round(_brute_auc(scores, labels), 4)) < 1e-9
    # average precision = sum over thresholds of (recall gain) * precision
    ap = 0.0
    P = sum(labels)
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        fp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)
        gain = sum(1 for s, y in zip(scores, labels) if s == t and y == 1) / P
        ap += gain * tp / (tp + fp)
    assert abs(L.pr_summary(df).first()["average_precision"] - round(ap, 4)) < 1e-9
    roc = {r["threshold"]: (r["tpr"], r["fpr"]) for r in L.roc_curve(df.repartition(4)).collect()}
    assert roc[0.8] == (2 / 5, 1 / 7)


def test_regression_and_classification_metrics(spark):
    rows = [(10.0, 12.0, 1, 1), (0.0, -2.0, 0, 0), (5.0, 5.0, 1, 0), (-3.0, 1.0, 0, 1)]
    df = spark.createDataFrame(rows, "target_delay_seconds double, prediction double, target_is_late int, p2 int")
    r = L.regression_metrics(df).first()
    ys, ps = [x[0] for x in rows], [x[1] for x in rows]
    mae = sum(abs(p - y) for p, y in zip(ps, ys)) / 4
    my = sum(ys) / 4
    r2 = 1 - sum((p - y) ** 2 for p, y in zip(ps, ys)) / sum((y - my) ** 2 for y in ys)
    assert r["mae"] == round(mae, 3) and abs(r["r2"] - round(r2, 4)) < 1e-9
    c = L.classification_metrics(df.withColumn("prediction", F.col("p2"))).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 1, 1, 1) and c["accuracy"] == 0.5


def test_route_finding_matches_brute_force(spark):
    """N36 counts trip pairs as |T1|·|T2| per (r1, r2, group); compare with
    explicit pair enumeration on a tiny network."""
    from transitlake.plans.queries import trips as qtr
    from transitlake.sources import schemas as S

    def ts(m):
        return dt.datetime(2025, 1, 1, 8, 0) + dt.timedelta(minutes=m)

    stops = [("O", None), ("X1", "X"), ("X2", "X"), ("X", None), ("D", None), ("Y", None)]
    sched = [  # trip, route, stop, seq, minute
        ("t1", "A", "O", 1, 0), ("t1", "A", "X1", 2, 10), ("t1", "A", "D", 3, 20),
        ("t2", "A", "O", 1, 5), ("t2", "A", "X1", 2, 15),
        ("t3", "B", "X2", 1, 30), ("t3", "B", "D", 2, 40),
        ("t4", "B", "X2", 1, 35), ("t4", "B", "D", 2, 45),
        ("t5", "C", "X", 1, 12), ("t5", "C", "D", 2, 50), ("t6", "A", "Y", 1, 0)]

    def stop_row(sid, parent):
        r = {f.name: None for f in S.STOPS.fields}
        r.update(stop_id=sid, name=f"stop {sid}", parent_station_id=parent, latitude=42.0, longitude=-71.0)
        return tuple(r[f.name] for f in S.STOPS.fields)

    def sched_row(t, r, s, q, mi):
        row = {f.name: None for f in S.SCHEDULES.fields}
        row.update(schedule_id=f"{t}-{q}", trip_id=t, route_id=r, stop_id=s, stop_sequence=q, direction_id=0,
                   arrival_time=ts(mi), departure_time=ts(mi + 1))
        return tuple(row[f.name] for f in S.SCHEDULES.fields)

    sch_schema = S.SCHEDULES
    from pyspark.sql import types as T
    sch_schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name in ("arrival_time", "departure_time")
                                             else f.dataType) for f in S.SCHEDULES.fields])

    class Raw:
        pass
    raw = Raw()
    raw.stops = spark.createDataFrame([stop_row(*x) for x in stops], S.STOPS)
    raw.schedules = spark.createDataFrame([sched_row(*x) for x in sched], sch_schema)
    raw.routes = spark.createDataFrame([(r, f"Route {r}", None, None, None, 3, "Bus", None, None, 1, None, None,
                                         True, None, None) for r in "ABC"], S.ROUTES)

    class M:
        pass
    m = M()
    m.raw = raw
    got = {(r["connection_type"], r["first_route_id"], r["second_route_id"], r["transfer_stop_id"]): r["matching_trips"]
           for r in qtr.find_routes(m, "O", "D").collect()}
    # brute force
    group = {s: (p or s) for s, p in stops}
    visits = [dict(trip=t, route=r, stop=s, seq=q) for t, r, s, q, _ in sched]
    exp = {}
    direct = {(o["route"]) : set() for o in visits}
    for o, d in itertools.product(visits, visits):
        if o["trip"] == d["trip"] and o["seq"] < d["seq"] and o["stop"] == "O" and d["stop"] == "D":
            direct[o["route"]].add(o["trip"])
    for r, ts_ in direct.items():
        if ts_:
            exp[("direct", r, None, None)] = len(ts_)
    pairs = {}
    for l1, l1d, l2, l2d in itertools.product(visits, repeat=4):
        if (l1["stop"] == "O" and l1["trip"] == l1d["trip"] and l1["seq"] < l1d["seq"]
                and group[l1d["stop"]] == group[l2["stop"]] and l1["route"] != l2["route"]
                and l2["trip"] == l2d["trip"] and l2["seq"] < l2d["seq"] and l2d["stop"] == "D"):
            pairs.setdefault(("transfer", l1["route"], l2["route"], group[l1d["stop"]]), set()).add((l1["trip"], l2["trip"]))
    exp.update({k: len(v) for k, v in pairs.items()})
    assert got == exp


def test_cross_validation_folds_and_scores(spark):
    """Every complete feature row lands in exactly one fold; each fold
    is scored once per model; mean/std are over the fold scores."""
    from transitlake.plans import features as FE
    from transitlake.plans.models import Models
    from transitlake.sources.proxy import RawTables
    from tests.conftest import SF_SMALL
    m = Models(RawTables(spark, SF_SMALL))
    data = L.with_folds(FE.feature_matrix(m)).cache()
    counts = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    assert set(counts) <= set(range(5)) and sum(counts.values()) == data.count()
    out = L.cross_validation(data, L.cv_models()).collect()
    assert sorted(r["fold"] for r in out) == list(range(5))
    vals = [r["value"] for r in out]
    mean = sum(vals) / len(vals)
    std = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
    assert all(abs(r["mean"] - mean) < 1e-3 and abs(r["std"] - std) < 1e-3 for r in out)
    assert all(r["metric"] == "mae" and r["value"] >= 0 for r in out)
