"""Load rules: full refresh, idempotent snapshot append, de-duplication,
load-all reports, statistics, partitioned landing writes and exports.

Tables are Parquet directories under one root (``<root>/raw_<entity>``);
every rule is a Spark read / join / write. Rewrites never overwrite the
directory being read: the new version is written beside it and swapped in.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.core import nullif_empty, round_half_away
from transitlake.operators.latest import dedupe_on
from transitlake.operators.tables import cluster_for_partitioned_write
from transitlake.session import ensure_conf
from transitlake.sources.schemas import DEDUPE_KEYS, REGISTRY, entity

DT = "dt"   # partition column of append-mode raw tables


# ---------------------------------------------------------------- plan level
def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str],
             prune_col: str | None = None) -> DataFrame:
    """Source rows to insert: DISTINCT source restricted to the target's
    columns, minus keys already present (null-safe ``<=>``, so NULL keys are
    matched instead of re-inserted). Missing target columns become NULL.

    ``prune_col`` names a partition column of the target that is a function
    of the keys (``dt`` of ``extracted_at``): the target is first cut to the
    partitions present in the batch (static partition filters on the scan),
    so an append reads the touched days, not the whole table. They are a
    range: two values and a flag come to the driver, whatever the batch."""
    if prune_col and prune_col in target.columns and prune_col in source.columns:
        p = F.col(prune_col)
        lo, hi, unknown = source.agg(F.min(p), F.max(p), F.count_if(p.isNull())).first()
        cond = F.lit(False) if lo is None else p.between(F.lit(lo), F.lit(hi))
        target = target.filter(cond | p.isNull() if unknown else cond)
    insert_cols = [c for c in target.columns if c in source.columns]
    if not insert_cols:
        raise ValueError("No loadable columns: source and target share no column")
    keyed = bool(keys) and all(k in insert_cols for k in keys)
    # With keys, the key de-dup that follows removes exact duplicates too,
    # so the separate DISTINCT shuffle is skipped.
    src = source.select(*insert_cols) if keyed else source.distinct().select(*insert_cols)
    if keyed:
        t = target.select(*keys)
        src = src.join(t, null_safe_on(src, t, keys), "left_anti")
    ttypes = {f.name: f.dataType for f in target.schema.fields}
    return src.select(*[F.col(c) if c in insert_cols else F.lit(None).cast(ttypes[c]).alias(c)
                        for c in target.columns])


def append_result(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table content after an idempotent append followed by a key de-dup."""
    out = target.unionByName(new_rows(target, source, keys))
    return dedupe_on(out, keys) if keys and all(k in out.columns for k in keys) else out


_INTEGERS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}   # decimal digits


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is none."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    pair = (type(a), type(b))
    if all(t in _INTEGERS for t in pair):
        return max((a, b), key=lambda t: _INTEGERS[type(t)])
    if all(isinstance(t, T.NumericType) for t in (a, b)):
        if T.FloatType in pair or T.DoubleType in pair:
            narrow = pair in ((T.FloatType, T.ShortType), (T.FloatType, T.ByteType), (T.ShortType, T.FloatType),
                              (T.ByteType, T.FloatType))
            return T.FloatType() if narrow else T.DoubleType()
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_INTEGERS[type(t)], 0)
                  for t in (a, b)]
        whole, scale = (max(d[i] for d in digits) for i in (0, 1))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if T.DateType in pair and (T.TimestampType in pair or T.TimestampNTZType in pair):
        return a if isinstance(b, T.DateType) else b
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Diagonal concat: union by name, missing columns NULL, each column in
    the common type of all frames (``common_type``)."""
    widest: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            widest[f.name] = common_type(widest[f.name], f.dataType) if f.name in widest else f.dataType
    out = None
    for df in frames:
        cast = df.select(*[F.col(f.name).cast(widest[f.name]) for f in df.schema.fields])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def partition_columns(df: DataFrame, ts_col: str = "extracted_at", hourly: bool = False) -> DataFrame:
    """Add ``dt=YYYY-MM-DD`` (and ``hr=HH``) from an instant column (UTC)."""
    ts = F.col(ts_col).cast("timestamp")
    df = df.withColumn("dt", F.date_format(ts, "yyyy-MM-dd"))
    return df.withColumn("hr", F.date_format(ts, "HH")) if hourly else df


# Columns of the route report (fixed values of the source).
ROUTE_REPORT = ("Route ID", "Route Name", "Mode", "On-Time %", "Avg Delay (min)", "Trips")


def route_report(routes: DataFrame) -> DataFrame:
    """The route report as text: no name shows the id, no number shows zero, measures keep one decimal."""
    def tenths(c: str) -> Column:
        return round_half_away(F.coalesce(c, F.lit(0.0)), 1).cast("decimal(18,1)").cast("string")
    cols = (F.col("route_id"), F.coalesce(nullif_empty("route_name"), "route_id"),
            F.coalesce("route_type_desc", F.lit("")), tenths("on_time_pct"), tenths("avg_delay_minutes"),
            F.coalesce("total_predictions", F.lit(0)).cast("string"))
    return routes.select(*[c.alias(n) for c, n in zip(cols, ROUTE_REPORT, strict=True)])


def report_csv(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """Export selected report columns as headed CSV files."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)
    return path


def route_lines_geojson(route_lines: DataFrame) -> DataFrame:
    """One GeoJSON ``LineString`` feature per route (JSON text per row).

    Stops are ordered by sequence, coordinates rounded to 5 decimals, and
    routes with fewer than two located stops are dropped; colours get a
    ``#`` prefix. The per-route point list is bounded by the route's stops.
    """
    pts = F.array_sort(F.collect_list(F.struct(
        F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("sid"),
        F.round(F.col("longitude"), 5).alias("lng"), F.round(F.col("latitude"), 5).alias("lat"))))
    g = (route_lines.groupBy("route_id", "route_type", "route_type_desc", "route_color")
         .agg(pts.alias("pts")))
    coords = F.transform("pts", lambda p: F.array(p["lng"], p["lat"]))
    g = g.filter(F.size("pts") >= 2)
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"),
        F.struct("route_id", "route_type", "route_type_desc",
                 F.concat(F.lit("#"), F.col("route_color")).alias("color")).alias("properties"))
    return g.select("route_id", F.to_json(feature).alias("feature"))


def stations_geojson(stations: DataFrame) -> DataFrame:
    """One GeoJSON ``Point`` feature per located station (JSON text per row)."""
    s = stations.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"),
                 F.array(round_half_away("longitude", 5), round_half_away("latitude", 5)).alias("coordinates"))
        .alias("geometry"),
        F.struct(*[c for c in s.columns if c not in ("latitude", "longitude")]).alias("properties"))
    return s.select("stop_id", F.to_json(feature).alias("feature"))


# ---------------------------------------------------------------- table root
class RawStore:
    """Raw tables as Parquet directories under ``root`` (``raw_<entity>``).

    ``unit`` sizes the partitions of append-mode tables to the data: ``day``,
    or ``month`` / ``year`` where a day holds too little for a file. ``dt`` is
    the first date of the unit.
    """

    def __init__(self, spark: SparkSession, root: str, unit: str = "day"):
        self.spark = ensure_conf(spark)
        self.root = root.rstrip("/")
        if unit not in ("day", "month", "year"):
            raise ValueError(f"unknown partition unit {unit!r}")
        self.unit = unit

    def partition_of(self, day: Column) -> Column:
        """``dt`` of a date."""
        return day if self.unit == "day" else F.trunc(day, self.unit).cast("date")

    # -- filesystem helpers (Hadoop FS through the session) -----------------
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return bool(fs.exists(p))

    def _swap(self, new_path: str, path: str) -> None:
        """Put the folder ``new_path`` in the place of ``path``.

        The old folder is deleted only once the new one is in place; if the
        new one cannot be moved (an exception or a false answer), the old one
        is moved back and the load fails with the table as it was.
        """
        fs, p = self._fs(path)
        jvm = self.spark.sparkContext._jvm
        new = jvm.org.apache.hadoop.fs.Path(new_path)
        old = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex[:8]}")
        if not fs.exists(new):
            raise FileNotFoundError(f"nothing was written to {new_path}")
        had = bool(fs.exists(p))
        if had and not fs.rename(p, old):
            raise OSError(f"{path} could not be moved aside")
        try:
            if not fs.rename(new, p):
                raise OSError(f"{new_path} could not be moved to {path}")
        except Exception:
            if had and not fs.exists(p):
                fs.rename(old, p)
            raise
        if had:
            fs.delete(old, True)

    def table_path(self, name: str) -> str:
        return f"{self.root}/raw_{entity(name).name}"

    def exists(self, name: str) -> bool:
        return self._exists(self.table_path(name))

    def table(self, name: str) -> DataFrame:
        """The table; append-mode tables carry their ``dt`` partition column."""
        return self.spark.read.parquet(self.table_path(name))

    def rows(self, name: str) -> DataFrame:
        """The table's rows in the entity's declared columns (no ``dt``)."""
        df = self.table(name)
        return df.drop(DT) if DT in df.columns else df

    # -- sources --------------------------------------------------------------
    def read_source(self, path: str, glob: str | None = None, schema: T.StructType | None = None) -> DataFrame:
        """All Parquet files under ``path`` (recursive; union by column name).

        Partition discovery is off: directory names like ``extracted_at=…``
        must not override the in-file columns. With a ``schema`` no footer is
        read before the scan: columns that a file lacks are NULL, others are
        left out. Without one the schemas of all files are merged.
        """
        r = self.spark.read.option("recursiveFileLookup", "true")
        r = r.schema(schema) if schema is not None else r.option("mergeSchema", "true")
        if glob:
            r = r.option("pathGlobFilter", glob)
        return r.parquet(path)

    # -- loads ----------------------------------------------------------------
    def _write_beside(self, df: DataFrame, path: str, partition_by: Sequence[str] = (),
                      keys: Sequence[str] = ()) -> None:
        tmp = f"{path}.new-{uuid.uuid4().hex[:8]}"
        w = cluster_for_partitioned_write(df, partition_by, keys).write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(tmp)
        self._swap(tmp, path)

    def load(self, name: str, source: DataFrame, count: bool = True) -> int:
        """Load one entity by its registry mode; returns the table row count.

        ``count=False`` leaves the count out (micro-batches: it would open
        every file of the table) and returns -1. Append-mode (snapshot) tables are partitioned by ``dt`` = date of
        ``extracted_at`` (UTC), the column every append key contains.
        """
        e = entity(name)
        path = self.table_path(name)
        keys = DEDUPE_KEYS.get(e.name, ())
        if e.mode == "replace":
            self._write_beside(source, path)
            return self.table(name).count() if count else -1
        part = "extracted_at" in source.columns
        if part:
            day = F.to_date(F.col("extracted_at").try_cast("timestamp"))
            source = source.withColumn(DT, self.partition_of(day))
        keyed = bool(keys) and all(k in source.columns for k in keys)
        if not self._exists(path):
            if source.isEmpty():
                # An empty batch (e.g. an empty landed file) creates no
                # table: a partitioned write of no rows leaves no files.
                return 0
            first = dedupe_on(source, keys) if keyed else source.distinct()
            if part:
                first = cluster_for_partitioned_write(first, (DT,), keys if keyed else ())
            w = first.write.mode("overwrite")
            (w.partitionBy(DT) if part else w).parquet(path)
        else:
            target = self.table(name)
            ins = new_rows(target, source, keys, prune_col=DT if part else None)
            if keyed:
                # The table is kept unique by key, so de-duplicating the new
                # rows among themselves leaves the whole table unique — no
                # full rewrite per append.
                ins = dedupe_on(ins, keys)
            if part and DT in ins.columns:
                ins = cluster_for_partitioned_write(ins, (DT,), keys if keyed else ())
            w = ins.write.mode("append")
            (w.partitionBy(DT) if part and DT in ins.columns else w).parquet(path)
        return self.table(name).count() if count else -1

    def merge(self, name: str, source: DataFrame) -> int:
        """Insert the rows of ``source`` whose key the table lacks (C7); returns the table's row count.

        The batch is staged first: reduced to one row per key and written
        beside the table, so the source is read once and a failure leaves the
        table as it was. A batch without all key columns, or an entity without
        keys, is an error before anything is written.
        """
        e = entity(name)
        keys = DEDUPE_KEYS.get(e.name, ())
        if not keys:
            raise ValueError(f"{e.name} has no key to merge on")
        missing = [k for k in keys if k not in source.columns]
        if missing:
            raise ValueError(f"a batch of {e.name} lacks the key columns {missing}")
        stage = f"{self.table_path(name)}.stage-{uuid.uuid4().hex[:8]}"
        try:
            dedupe_on(source, keys).write.parquet(stage)
            return self.load(name, self.spark.read.parquet(stage))
        finally:
            fs, p = self._fs(stage)
            fs.delete(p, True)

    def sql(self, query: str) -> DataFrame:
        """Ad-hoc SQL over the store's tables, each by its name ``raw_<entity>`` (C11).

        The names live in a session of their own and clash with no view of the caller.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.session.timeZone", self.spark.conf.get("spark.sql.session.timeZone"))
        for n in REGISTRY:
            if self.exists(n):
                session.read.parquet(self.table_path(n)).createOrReplaceTempView(f"raw_{n}")
        return session.sql(query)

    def load_path(self, name: str, path: str, glob: str | None = None, declared: bool = False) -> int:
        """Load the files under ``path``; ``declared`` reads them with the entity's declared schema."""
        schema = entity(name).schema if declared else None
        return self.load(name, self.read_source(path, glob, schema))

    def dedupe(self, name: str) -> int:
        """Remove duplicate rows by the entity key (no-op without keys);
        returns the row count. Written beside the table, then swapped in."""
        e = entity(name)
        if not self.exists(name):
            return 0
        df = self.table(name)
        keys = DEDUPE_KEYS.get(e.name)
        if not keys or not all(k in df.columns for k in keys):
            return df.count()
        self._write_beside(dedupe_on(df, keys), self.table_path(name),
                           partition_by=(DT,) if DT in df.columns else (), keys=keys)
        return self.table(name).count()

    def load_all(self, landing_root: str) -> DataFrame:
        """Load every entity from ``landing_root/<entity>``; a failure is
        isolated as -1, an entity without files reports 0."""
        rows = []
        for name in REGISTRY:
            src = f"{landing_root.rstrip('/')}/{name}"
            try:
                rows.append((name, self.load_path(name, src) if self._exists(src) else 0))
            except Exception:  # noqa: BLE001 - isolate per entity
                rows.append((name, -1))
        return self.spark.createDataFrame(rows, "entity string, row_count long")

    def stats(self) -> DataFrame:
        """Row count per existing raw table (one union of counts)."""
        parts = [self.table(n).agg(F.lit(f"raw_{n}").alias("table_name"),
                                   F.count(F.lit(1)).alias("row_count"))
                 for n in REGISTRY if self.exists(n)]
        if not parts:
            return self.spark.createDataFrame([], "table_name string, row_count long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def preview(self, name: str, n: int = 5) -> DataFrame:
        return self.table(name).limit(n)

    # -- landing writes (C1/C2) ------------------------------------------------
    def land(self, name: str, df: DataFrame, landing_root: str,
             extracted_at: str | None = None) -> str:
        """Land a batch: every row stamped with one ``extracted_at`` (UTC
        ISO text) and written under ``dt=`` (dimensions) or ``dt=/hr=``
        (facts); dimension partitions are replaced dynamically."""
        e = entity(name)
        if extracted_at is not None or "extracted_at" not in df.columns:
            ts = extracted_at or time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())
            df = df.withColumn("extracted_at", F.lit(ts))
        df = partition_columns(df, "extracted_at", hourly=e.kind == "fact")
        path = f"{landing_root.rstrip('/')}/{e.name}"
        keys = [k for k in DEDUPE_KEYS.get(e.name, ()) if k in df.columns]
        df = cluster_for_partitioned_write(df, e.partition_cols, keys)
        w = df.write.partitionBy(*e.partition_cols)
        if e.kind == "dimension":
            w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        else:
            w = w.mode("append")
        w.parquet(path)
        return path
