"""Canonical transit tables derived from the driver's TPC-H-like tables.

Every rule is integer arithmetic on keys, so the same rows come out of any
engine. Times are produced as instants (the landed ISO text would be cast
to the same instants by staging, which is idempotent on timestamps).

=============  ====================  =========================================
canonical      from                  rule (k = key)
=============  ====================  =========================================
routes         nation                route_id = n_nationkey, route_type = n_regionkey
stops          supplier ⨝ nation     stop_id = s_suppkey, municipality = n_name
trips          orders ⨝ customer     trip_id = o_orderkey, route_id = c_nationkey
schedules      lineitem ⨝ trips      one stop visit per line item
predictions    lineitem ⨝ trips      same visits, predicted with a key-hash offset
vehicles       events                one position snapshot per event
alerts         events (error)        alert versions keyed by user
weather        prediction hours      hourly observation per distinct hour
messages       conversations         user turns (rider messages)
=============  ====================  =========================================

``nation`` (25 rows) is the only side this module broadcasts explicitly:
its size is fixed by the data model. Every other join is left to the
planner's size-checked broadcast threshold and AQE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.functions.labels import (
    location_type_desc, route_type_desc, vehicle_type_desc,
)
from transitlake.session import ensure_conf

# Fixed proxy vocabularies (positions are selected by key % len).
ALERT_LIFECYCLES = ["ONGOING", "NEW", "UPCOMING", "ENDED"]
ALERT_EFFECTS = ["SUSPENSION", "DETOUR", "DELAY", "SERVICE_CHANGE", "STATION_ISSUE",
                 "STOP_MOVED", "OTHER"]
ALERT_CAUSES = ["CONSTRUCTION", "MAINTENANCE", "UNKNOWN_CAUSE"]
WEATHER_CODES = [0, 1, 2, 3, 45, 51, 61, 71, 80, 95]
VEHICLE_STATUS = {"view": "STOPPED_AT", "click": "IN_TRANSIT_TO", "signup": "INCOMING_AT"}


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(idx: Column, values: list) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(idx == i, F.lit(v)) if out is None else out.when(idx == i, F.lit(v))
    return out


def _ts(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def _epoch(c: Column) -> Column:
    return c.cast("timestamp").cast("long")


class DriverTables:
    """Lazy readers of the driver's parquet tables, column-pruned by Catalyst."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_conf(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


ENTITIES = ("routes", "stops", "trips", "schedules", "predictions", "vehicles", "alerts",
            "weather")


class RawTables:
    """The eight raw entities plus the mode seed, derived from driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.driver = DriverTables(spark, sf_dir)
        self.spark = self.driver.spark

    @classmethod
    def landed(cls, spark: SparkSession, raw_dir: str) -> "LandedRawTables":
        return LandedRawTables(spark, raw_dir)

    def land(self, out_dir: str, files_per_fact: int = 0) -> str:
        """Write every raw entity as Parquet under ``out_dir/<entity>``.

        Facts are clustered by trip/vehicle/alert id into ``files_per_fact``
        files (default: the session's shuffle partitions), which also sorts
        rows within files by that id so row-group min/max can skip.
        """
        from pyspark import StorageLevel
        n = files_per_fact or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # The visit join feeds schedules, predictions and weather; events
        # feed vehicles and alerts: keep them for the duration of the landing.
        shared = [self._visits.persist(StorageLevel.MEMORY_AND_DISK),
                  self._events.persist(StorageLevel.MEMORY_AND_DISK)]
        cluster = {"schedules": "trip_id", "predictions": "trip_id", "vehicles": "vehicle_id",
                   "alerts": "alert_id", "trips": "trip_id"}
        for name in ENTITIES:
            df = getattr(self, name)
            if name in cluster:
                df = df.repartition(n, cluster[name]).sortWithinPartitions(cluster[name])
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
        for df in shared:
            df.unpersist()
        return out_dir

    # -- dimensions -------------------------------------------------------
    @cached_property
    def routes(self) -> DataFrame:
        n = self.driver.read("nation")
        k = F.col("n_nationkey")
        rt = F.col("n_regionkey").cast("int")
        return n.select(
            _s(k).alias("route_id"),
            F.col("n_name").alias("long_name"),
            F.when(k % 3 == 0, F.lit("")).otherwise(_s(k)).alias("short_name"),
            F.concat(route_type_desc(rt), F.lit(" route")).alias("description"),
            route_type_desc(rt).alias("fare_class"),
            rt.alias("route_type"),
            route_type_desc(rt).alias("route_type_desc"),
            F.when(k % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("00"), F.lpad(_s(k * 7), 4, "0"))).alias("color"),
            F.lit("FFFFFF").alias("text_color"),
            (rt * 100 + k).cast("int").alias("sort_order"),
            F.array(F.lit("Outbound"), F.lit("Inbound")).alias("direction_names"),
            F.array(F.concat(F.col("n_name"), F.lit(" A")),
                    F.concat(F.col("n_name"), F.lit(" B"))).alias("direction_destinations"),
            F.lit(True).alias("listed_route"),
            F.concat(F.lit("line-"), _s(rt)).alias("line_id"),
            F.lit("1").alias("agency_id"),
        )

    @cached_property
    def route_type_mapping(self) -> DataFrame:
        from transitlake.sources.landed import route_type_seed
        return route_type_seed(self.spark)

    @cached_property
    def stops(self) -> DataFrame:
        s = self.driver.read("supplier")
        n = F.broadcast(self.driver.read("nation").select("n_nationkey", "n_name"))
        k = F.col("s_suppkey")
        lt = (k % 3).cast("int")
        vt = F.when(k % 3 == 1, F.lit(None).cast("int")).otherwise((k % 5).cast("int"))
        return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
            _s(k).alias("stop_id"),
            F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.when(k % 50 == 0, F.lit(None).cast("double"))
             .otherwise(F.lit(41.0) + (k % 200).cast("double") / F.lit(100.0)).alias("latitude"),
            (F.lit(-72.0) + ((k * 7) % 200).cast("double") / F.lit(100.0)).alias("longitude"),
            F.lit(None).cast("string").alias("address"),
            F.col("n_name").alias("municipality"),
            F.lit(None).cast("string").alias("on_street"),
            F.lit(None).cast("string").alias("at_street"),
            lt.alias("location_type"),
            location_type_desc(lt).alias("location_type_desc"),
            vt.alias("vehicle_type"),
            vehicle_type_desc(vt).alias("vehicle_type_desc"),
            F.lit(None).cast("string").alias("platform_code"),
            F.lit(None).cast("string").alias("platform_name"),
            (k % 3).cast("int").alias("wheelchair_boarding"),
            F.when(k % 5 != 0, _s(k - k % 5)).alias("parent_station_id"),
            F.concat(F.lit("Z"), _s(k % 10)).alias("zone_id"),
        )

    @cached_property
    def _order_routes(self) -> DataFrame:
        o = self.driver.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_orderpriority")
        c = self.driver.read("customer").select("c_custkey", "c_nationkey")
        return o.join(c, o.o_custkey == c.c_custkey, "inner")

    @cached_property
    def trips(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self._order_routes.select(
            _s(k).alias("trip_id"),
            F.concat(F.lit("Headsign "), _s(k % 7)).alias("headsign"),
            F.when(k % 2 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
            (k % 2).cast("int").alias("direction_id"),
            F.concat(F.lit("B"), _s(k % 100)).alias("block_id"),
            (k % 2).cast("int").alias("bikes_allowed"),
            F.lit(1).alias("wheelchair_accessible"),
            F.lit("REVENUE").alias("revenue"),
            _s(F.col("c_nationkey")).alias("route_id"),
            F.concat(_s(F.col("c_nationkey")), F.lit("-"), _s(k % 2)).alias("route_pattern_id"),
            F.col("o_orderstatus").alias("service_id"),
            F.lit(None).cast("string").alias("shape_id"),
        )

    # -- facts ------------------------------------------------------------
    @cached_property
    def _visits(self) -> DataFrame:
        """Line items with their trip's route: one scheduled stop visit each."""
        li = self.driver.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus",
            "l_shipdate")
        tr = self._order_routes.select("o_orderkey", "c_nationkey")
        v = li.join(tr, li.l_orderkey == tr.o_orderkey, "inner")
        base = _epoch(F.col("l_shipdate")) + (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 600) % 86400
        return v.withColumn("_base", base)

    @cached_property
    def schedules(self) -> DataFrame:
        ln = F.col("l_linenumber")
        return self._visits.select(
            F.concat(_s(F.col("l_orderkey")), F.lit("-"), _s(ln)).alias("schedule_id"),
            F.when(ln == 1, F.lit(None).cast("timestamp")).otherwise(_ts(F.col("_base"))).alias("arrival_time"),
            F.when(ln == 7, F.lit(None).cast("timestamp")).otherwise(_ts(F.col("_base") + 30)).alias("departure_time"),
            (F.col("l_orderkey") % 2).cast("int").alias("direction_id"),
            ln.cast("int").alias("stop_sequence"),
            F.concat(F.lit("Headsign "), _s(F.col("l_orderkey") % 7)).alias("stop_headsign"),
            F.lit(0).alias("pickup_type"),
            F.lit(0).alias("drop_off_type"),
            (ln % 2 == 1).alias("timepoint"),
            _s(F.col("c_nationkey")).alias("route_id"),
            _s(F.col("l_suppkey")).alias("stop_id"),
            _s(F.col("l_orderkey")).alias("trip_id"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        ln = F.col("l_linenumber")
        off = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + ln * 101) % 6000 - 2100
        unc = F.when(ln % 3 == 0, F.lit(None).cast("int")).otherwise(
            (F.lit(60) + (F.col("l_partkey") % 5) * 30).cast("int"))
        return self._visits.select(
            _s(F.col("l_partkey")).alias("prediction_id"),
            F.when(ln == 1, F.lit(None).cast("timestamp")).otherwise(_ts(F.col("_base") + off)).alias("arrival_time"),
            unc.alias("arrival_uncertainty"),
            F.when(ln == 7, F.lit(None).cast("timestamp")).otherwise(_ts(F.col("_base") + off + 30)).alias("departure_time"),
            unc.alias("departure_uncertainty"),
            (F.col("l_orderkey") % 2).cast("int").alias("direction_id"),
            ln.cast("int").alias("stop_sequence"),
            F.lit("SCHEDULED").alias("schedule_relationship"),
            F.col("l_linestatus").alias("status"),
            F.lit("REVENUE").alias("revenue"),
            F.lit(False).alias("last_trip"),
            F.lit("MID_TRIP").alias("update_type"),
            _s(F.col("c_nationkey")).alias("route_id"),
            _s(F.col("l_suppkey")).alias("stop_id"),
            _s(F.col("l_orderkey")).alias("trip_id"),
            F.concat(F.lit("v"), _s(F.col("l_orderkey") % 50)).alias("vehicle_id"),
            _ts(_epoch(F.col("l_shipdate")) + (F.col("l_orderkey") * 37) % 86400 + ln * 60).alias("extracted_at"),
        )

    @cached_property
    def _events(self) -> DataFrame:
        e = self.driver.read("events")
        return e.withColumn("_k", F.get_json_object("props", "$.k").cast("long"))

    @cached_property
    def vehicles(self) -> DataFrame:
        e, k, eid = self._events, F.col("_k"), F.col("event_id")
        status = None
        for et, st in VEHICLE_STATUS.items():
            cond = F.col("event_type") == et
            status = F.when(cond, F.lit(st)) if status is None else status.when(cond, F.lit(st))
        return e.select(
            _s(F.col("user_id")).alias("vehicle_id"),
            F.concat(F.lit("V"), _s(F.col("user_id") % 1000)).alias("label"),
            (F.lit(42.0) + (eid % 100).cast("double") / F.lit(1000.0)).alias("latitude"),
            (F.lit(-71.0) - (F.col("user_id") % 100).cast("double") / F.lit(1000.0)).alias("longitude"),
            (eid % 360).cast("int").alias("bearing"),
            F.col("value").alias("speed"),
            status.alias("current_status"),
            (eid % 20 + 1).cast("int").alias("current_stop_sequence"),
            (eid % 2).cast("int").alias("direction_id"),
            F.when(k < 30, F.lit("MANY_SEATS_AVAILABLE")).when(k < 70, F.lit("FEW_SEATS_AVAILABLE"))
             .otherwise(F.lit("FULL")).alias("occupancy_status"),
            (eid % 4).cast("int").alias("carriage_count"),
            F.when(eid % 4 == 0, F.lit(None).cast("double")).otherwise(k.cast("double")).alias("avg_occupancy_pct"),
            F.lit("REVENUE").alias("revenue"),
            F.col("ts").cast("timestamp").alias("updated_at"),
            _s(eid % 25).alias("route_id"),
            F.when(eid % 10 == 9, F.lit(None).cast("string"))
             .when(eid % 10 == 8, F.lit("999999"))
             .otherwise(_s((eid * 7) % 97 + 1)).alias("stop_id"),
            _s(eid % 500).alias("trip_id"),
            F.col("ts").cast("timestamp").alias("extracted_at"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        e = self._events.filter(F.col("event_type") == "error")
        k, eid, uid = F.col("_k"), F.col("event_id"), F.col("user_id")
        ts = _epoch(F.col("ts"))
        effect = _pick(eid % 7, ALERT_EFFECTS)
        header = F.concat(F.lit("Alert "), _s(eid))
        return e.select(
            _s(uid).alias("alert_id"),
            _pick(eid % 3, ALERT_CAUSES).alias("cause"),
            effect.alias("effect"),
            F.when(eid % 13 == 0, F.lit(None).cast("int")).otherwise((k % 10).cast("int")).alias("severity"),
            _pick(eid % 4, ALERT_LIFECYCLES).alias("lifecycle"),
            header.alias("header"),
            header.alias("description"),
            F.when(eid % 2 == 0, F.lit("")).otherwise(header).alias("short_header"),
            effect.alias("service_effect"),
            F.lit("KNOWN").alias("duration_certainty"),
            F.col("ts").cast("timestamp").alias("active_start"),
            F.when(eid % 3 == 0, F.lit(None).cast("timestamp")).otherwise(_ts(ts + k * 3600)).alias("active_end"),
            F.col("ts").cast("timestamp").alias("created_at"),
            F.when(eid % 6 == 5, F.lit(None).cast("timestamp")).otherwise(F.col("ts").cast("timestamp")).alias("updated_at"),
            F.when(eid % 9 == 4, _ts(ts + 7200)).otherwise(F.lit(None).cast("timestamp")).alias("closed_timestamp"),
            F.lit(None).cast("string").alias("url"),
            F.array_sort(F.array_distinct(F.array(_s(uid % 25), _s(eid % 25)))).alias("affected_routes"),
            F.array_sort(F.array_distinct(F.array(_s(eid % 97 + 1), _s(uid % 97 + 1)))).alias("affected_stops"),
            k.cast("int").alias("informed_entity_count"),
            _ts(ts + 60).alias("extracted_at"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        p = self.predictions
        h = F.floor(_epoch(F.coalesce("arrival_time", "departure_time")) / 3600).alias("h")
        hours = p.select(h).filter(F.col("h").isNotNull()).distinct().filter(F.col("h") % 11 != 0)
        h = F.col("h")
        temp = ((h * 7) % 55 - 15).cast("double")
        precip = F.when(h % 5 == 0, (h % 40).cast("double") / F.lit(10.0)).otherwise(F.lit(0.0))
        return hours.select(
            _ts(h * 3600).alias("timestamp"),
            temp.alias("temperature_2m"),
            (h % 60 + 30).cast("double").alias("relative_humidity_2m"),
            precip.alias("precipitation"),
            F.when(temp >= 0, precip).otherwise(F.lit(0.0)).alias("rain"),
            F.when(temp < 0, precip).otherwise(F.lit(0.0)).alias("snowfall"),
            ((h * 13) % 60).cast("double").alias("wind_speed_10m"),
            ((h * 13) % 60 + 10).cast("double").alias("wind_gusts_10m"),
            (((h * 17) % 30) * 1000).cast("double").alias("visibility"),
            _pick(h % 10, WEATHER_CODES).cast("int").alias("weather_code"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Rider messages: the user turns of ``conversations``."""
        c = self.driver.read("conversations")
        return c.filter(F.col("role") == "user").select(
            F.col("conv_id").alias("message_id"), F.col("turn"), F.col("text"))

    @cached_property
    def trip_requests(self) -> DataFrame:
        """Rider messages that name a stop and a municipality (one customer in ten asks something else)."""
        s = self.driver.read("supplier").select("s_suppkey", "s_name")
        n = F.broadcast(self.driver.read("nation").select("n_nationkey", "n_name"))
        c = self.driver.read("customer").select("c_custkey", "c_nationkey")
        k = F.col("c_custkey")
        stops = s.agg(F.count(F.lit(1))).scalar()
        c = c.join(s, k % stops == s.s_suppkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
        tail = _pick((k % 3).cast("int"), [" now", "? Thanks", " please"])
        trip = F.concat(F.lit("How do I get from "), F.coalesce("s_name", F.lit("here")), F.lit(" to "),
                        F.coalesce("n_name", F.lit("there")), tail)
        return c.select(k.alias("message_id"),
                        F.when(k % 10 == 9, F.lit("Any delays on the red line")).otherwise(trip).alias("text"))

    def entity(self, name: str) -> DataFrame:
        from transitlake.sources.schemas import entity
        entity(name)
        return getattr(self, name)


class LandedRawTables(RawTables):
    """Raw entities read back from a landed Parquet tree (``land``'s layout)."""

    def __init__(self, spark: SparkSession, raw_dir: str):
        self.spark = ensure_conf(spark)
        self.raw_dir = raw_dir.rstrip("/")
        for name in ENTITIES:
            self.__dict__[name] = self.spark.read.parquet(f"{self.raw_dir}/{name}")
