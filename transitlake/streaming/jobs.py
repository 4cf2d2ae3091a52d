"""Streaming operators (Q1–Q8).

* ``ingest_stream``: landed snapshot files → typed stream (schema given,
  never inferred); several landing folders fan in as one union; files per
  trigger bounded by ``maxFilesPerTrigger``.
* ``append_exactly_once``: ``foreachBatch`` + the idempotent append rule
  (DISTINCT, null-safe anti join on the entity key, key de-dup). A replayed
  micro-batch or a replayed stream inserts nothing twice.
* ``latest_state``: the latest row per key as a streaming aggregation
  (``max_by`` over an ordering struct — ``row_number`` is not allowed on
  streams). The state store holds one row per key; each trigger emits the
  changed keys (update mode) into a change log whose newest entry per key
  is the current state. A late, older snapshot never replaces a newer one
  because the order is part of the aggregate, not of arrival.
* ``stop_activity_stream``: ``foreachBatch`` over the exactly-once raw table;
  the hours a batch touches are computed again with the batch model, so late
  and replayed rows are right at any time.
* ``latest_upserts``: the same latest rows in an upsert table that is
  compacted as the stream goes on; with the service day as its part, days that
  no late row reaches are sealed.
* ``delay_stream``: each arriving prediction joined to static schedules and
  dimensions (stream–static join) by the batch model, over the range of
  schedules that the batch can meet.
* ``freshness_monitor``: the freshness check on every micro-batch.

Stateful queries use the RocksDB state store (state on local disk of each
executor, changelog checkpoints to the shared folder) unless the session
already names a provider: the latest-state and window states grow with the
number of keys, which a heap-resident store cannot hold at scale. The
provider is recorded in the checkpoint, so a restart keeps it.

Checkpoints and sinks live under a root the caller passes (by default the
session's shared ``spark.checkpoint.dir``), so a restarted query resumes
from its last committed offsets on any executor set.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.operators.latest import latest_per_key
from transitlake.operators.loads import DT, RawStore
from transitlake.operators.upserts import UpsertTable
from transitlake.plans import staging
from transitlake.plans.intermediate import scheduled_vs_actual, stop_activity
from transitlake.session import checkpoint_dir


def stream_root(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/transitlake-stream/{name}-{uuid.uuid4().hex[:8]}"


def land_in_time_order(df: DataFrame, path: str, ts_col: str, files: int, newest_first: bool = False) -> str:
    """Write ``df`` as ``files`` Parquet files, each a contiguous range of
    ``ts_col`` (range partitioning), to arrive in or against event-time order."""
    df.repartitionByRange(files, F.col(ts_col)).write.mode("overwrite").parquet(path)
    # The file source replays files by modification time: stamp them in
    # range order so they arrive as the events happened.
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((str(st.getPath().toString()) for st in fs.listStatus(p)
                    if st.getPath().getName().startswith("part-")), reverse=newest_first)
    base = 1_600_000_000_000
    for i, f in enumerate(parts):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f), base + i * 60_000, -1)
    return path


def ingest_stream(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType,
                  max_files_per_trigger: int = 1) -> DataFrame:
    """Typed stream over one or more landing folders (fan-in union)."""
    if isinstance(paths, str):
        paths = [paths]
    out = None
    for p in paths:
        s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
             .parquet(p))
        out = s if out is None else out.unionByName(s)
    return out


_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def ensure_state_store(spark: SparkSession) -> None:
    """Use the RocksDB state store where the session sets no provider."""
    for k, v in _STATE_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)


#: Trigger of streams that keep running.
TRIGGER = "5 minutes"


def _run(writer, checkpoint: str, available_now: bool = True, trigger: str = TRIGGER):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def append_exactly_once(stream: DataFrame, store: RawStore, entity: str, checkpoint: str,
                        available_now: bool = True):
    """Append every micro-batch to ``store``'s raw table idempotently."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        store.load(entity, batch, count=False)
    return _run(stream.writeStream.foreachBatch(sink), checkpoint, available_now)


def latest_upserts(stream: DataFrame, table: UpsertTable, checkpoint: str, available_now: bool = True):
    """Keep the latest row per key in an upsert table: no state store, and a log that compaction bounds."""
    return _run(stream.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id)),
                checkpoint, available_now)


def _change_log_sink(path: str):
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(path)
    return sink


def latest_state(stream: DataFrame, keys: Sequence[str], order: Sequence, change_log: str,
                 checkpoint: str, available_now: bool = True):
    """Maintain the latest row per ``keys`` (greatest ``order`` tuple)."""
    ensure_state_store(stream.sparkSession)
    cols = stream.columns
    ordering = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}")
                          for i, o in enumerate(order)])
    agg = (stream.groupBy(*keys)
           .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_row"))
           .select(*[F.col("_row")[c].alias(c) for c in cols]))
    w = agg.writeStream.outputMode("update").foreachBatch(_change_log_sink(change_log))
    return _run(w, checkpoint, available_now)


def read_current(spark: SparkSession, change_log: str, keys: Sequence[str]) -> DataFrame:
    """Current state from a change log: the newest entry per key."""
    log = spark.read.parquet(change_log)
    cols = [c for c in log.columns if c != "_batch_id"]
    return latest_per_key(log, keys, ["_batch_id"]).select(*cols)


def stop_activity_stream(vehicles: DataFrame, store: RawStore, stops: DataFrame, routes: DataFrame,
                         change_log: str, checkpoint: str, available_now: bool = True):
    """Hourly per-stop activity from a stream of raw vehicle positions.

    Every micro-batch is appended exactly once to ``store``'s raw table and
    the (stop, hour) groups it touches are computed again from that table with
    the batch model. So late rows count however late they are, replayed ones
    count once, and the stream cannot drift from the batch model. A batch
    reads the days it touches (partition range), not the table.
    """
    hour = F.date_trunc("hour", F.col("extracted_at").cast("timestamp"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.load("vehicles", batch, count=False)
        if not store.exists("vehicles"):
            return
        touched = batch.filter(F.col("stop_id").isNotNull()).select("stop_id", hour.alias("_hour")).distinct()
        part = store.partition_of(F.to_date("_hour"))
        first, last = touched.agg(F.min(part), F.max(part)).first()
        if first is None:
            return
        rows = store.table("vehicles").filter(F.col(DT).between(F.lit(first), F.lit(last)))
        rows = rows.withColumn("_hour", hour).join(touched, ["stop_id", "_hour"], "left_semi").drop("_hour", DT)
        groups = stop_activity(staging.stg_vehicles(rows), staging.stg_stops(stops), staging.stg_routes(routes))
        groups.withColumn("_batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(change_log)

    return _run(vehicles.writeStream.foreachBatch(sink), checkpoint, available_now)


DELAY_COLS = ["prediction_id", "route_id", "route_name", "stop_id", "stop_name", "trip_id", "direction_id",
              "stop_sequence", "service_date", "scheduled_arrival", "scheduled_departure", "predicted_arrival",
              "predicted_departure", "delay_seconds", "delay_category", "is_late", "extracted_at"]


def schedules_of(batch: DataFrame, schedules: DataFrame) -> DataFrame:
    """The raw schedules that can share a service date with the typed predictions of ``batch``.

    Two instants of one service date lie less than a day apart, so the batch's
    first and last predicted instant, a day wider, bound the scan: two values
    reach the driver and become a pushed range on the schedules' times.
    """
    at = F.coalesce("predicted_arrival", "predicted_departure")
    first, last = batch.agg(F.min(at), F.max(at)).first()
    if first is None:
        return schedules.filter(F.lit(False))
    low, high = (F.lit(t + dt.timedelta(days=d)) for t, d in ((first, -1), (last, 1)))
    arrives, departs = F.col("arrival_time"), F.col("departure_time")
    return schedules.filter(arrives.between(low, high) | (arrives.isNull() & departs.between(low, high)))


def delay_stream(predictions: DataFrame, schedules: DataFrame, routes: DataFrame, stops: DataFrame, out: str,
                 checkpoint: str, tz: str = "UTC", available_now: bool = True):
    """Delay of each arriving prediction snapshot against the static schedules.

    Every micro-batch is computed by the batch model over the part of the
    schedules that its own range of instants can meet, and replaces its own
    folder of ``out``, so a repeated batch adds nothing.
    """
    routes, stops = staging.stg_routes(routes), staging.stg_stops(stops)

    def sink(batch: DataFrame, batch_id: int) -> None:
        p = staging.typed_predictions(batch)
        s = staging.stg_schedules(schedules_of(p, schedules))
        rows = scheduled_vs_actual(p, s, routes, stops, tz).select(*DELAY_COLS)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _run(predictions.writeStream.foreachBatch(sink), checkpoint, available_now)


def freshness_monitor(stream: DataFrame, entity: str, results_path: str, checkpoint: str,
                      available_now: bool = True, now=None):
    """Append a freshness result row per micro-batch: the age of the
    batch's newest snapshot at ``now`` (default: the batch's processing
    time)."""
    from transitlake.functions.core import lit_ts
    from transitlake.operators.quality import freshness

    def sink(batch: DataFrame, batch_id: int) -> None:
        at = lit_ts(now) if now is not None else F.current_timestamp()
        freshness({entity: batch}, at).withColumn("batch_id", F.lit(batch_id).cast("long")) \
            .write.mode("append").parquet(results_path)
    return _run(stream.writeStream.foreachBatch(sink), checkpoint, available_now)
