"""Landed JSON documents → typed raw rows (batch or stream).

JSON:API documents (``{"data": [{id, type, attributes, relationships}]}``)
are read with an explicit schema (never inferred), exploded to one row per
resource and flattened: attributes become columns, a to-one relationship
``rel`` becomes ``rel_id`` (NULL when its ``data`` is null) and a to-many
relationship becomes ``rel_ids``; an attribute named ``type`` replaces the
resource type. Entity typing (labels, carriage occupancy, alert windows)
is then a plain ``select``. Works unchanged on ``readStream`` sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.functions.core import nullif_empty
from transitlake.functions.labels import location_type_desc, route_type_desc, vehicle_type_desc
from transitlake.sources import schemas as S

s, i, d, b = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
sa = T.ArrayType(s)
REF = T.StructType([T.StructField("id", s), T.StructField("type", s)])

# attributes (name, type) and relationships per entity
ATTRS = {
    "routes": [("long_name", s), ("short_name", s), ("description", s), ("fare_class", s),
               ("type", i), ("color", s), ("text_color", s), ("sort_order", i),
               ("direction_names", sa), ("direction_destinations", sa), ("listed_route", b)],
    "stops": [("name", s), ("description", s), ("latitude", d), ("longitude", d), ("address", s),
              ("municipality", s), ("on_street", s), ("at_street", s), ("location_type", i),
              ("vehicle_type", i), ("platform_code", s), ("platform_name", s),
              ("wheelchair_boarding", i)],
    "trips": [("headsign", s), ("name", s), ("direction_id", i), ("block_id", s),
              ("bikes_allowed", i), ("wheelchair_accessible", i), ("revenue", s)],
    "schedules": [("arrival_time", s), ("departure_time", s), ("direction_id", i),
                  ("stop_sequence", i), ("stop_headsign", s), ("pickup_type", i),
                  ("drop_off_type", i), ("timepoint", b)],
    "predictions": [("arrival_time", s), ("arrival_uncertainty", i), ("departure_time", s),
                    ("departure_uncertainty", i), ("direction_id", i), ("stop_sequence", i),
                    ("schedule_relationship", s), ("status", s), ("revenue", s),
                    ("last_trip", b), ("update_type", s)],
    "vehicles": [("label", s), ("latitude", d), ("longitude", d), ("bearing", i), ("speed", d),
                 ("current_status", s), ("current_stop_sequence", i), ("direction_id", i),
                 ("occupancy_status", s), ("revenue", s), ("updated_at", s),
                 ("carriages", T.ArrayType(T.StructType([
                     T.StructField("label", s), T.StructField("occupancy_status", s),
                     T.StructField("occupancy_percentage", i)])))],
    "alerts": [("cause", s), ("effect", s), ("severity", i), ("lifecycle", s), ("header", s),
               ("description", s), ("short_header", s), ("service_effect", s),
               ("duration_certainty", s), ("created_at", s), ("updated_at", s),
               ("closed_timestamp", s), ("url", s),
               ("active_period", T.ArrayType(T.StructType([T.StructField("start", s),
                                                           T.StructField("end", s)]))),
               ("informed_entity", T.ArrayType(T.StructType([
                   T.StructField("stop", s), T.StructField("route", s),
                   T.StructField("route_type", i), T.StructField("activities", sa)])))],
}
TO_ONE = {
    "routes": ["line", "agency"], "stops": ["parent_station", "zone"],
    "trips": ["route", "route_pattern", "service", "shape"],
    "schedules": ["route", "stop", "trip"],
    "predictions": ["route", "stop", "trip", "vehicle"],
    "vehicles": ["route", "stop", "trip"], "alerts": [],
}
TO_MANY = {"stops": ["child_stops"]}


def document_schema(entity: str) -> T.StructType:
    rels = [T.StructField(r, T.StructType([T.StructField("data", REF)])) for r in TO_ONE[entity]]
    rels += [T.StructField(r, T.StructType([T.StructField("data", T.ArrayType(REF))]))
             for r in TO_MANY.get(entity, [])]
    item = [T.StructField("id", s), T.StructField("type", s),
            T.StructField("attributes", T.StructType([T.StructField(n, t) for n, t in ATTRS[entity]]))]
    if rels:
        item.append(T.StructField("relationships", T.StructType(rels)))
    # ``extracted_at`` is the landing stamp written beside the payload.
    return T.StructType([T.StructField("extracted_at", s),
                         T.StructField("data", T.ArrayType(T.StructType(item)))])


def flatten(docs: DataFrame, entity: str) -> DataFrame:
    """One row per resource with attributes and relationship ids as columns."""
    r = docs.select("extracted_at", F.explode("data").alias("r"))
    names = [n for n, _ in ATTRS[entity]]
    cols = [F.col("extracted_at").alias("_landed_at"), F.col("r.id").alias("id")]
    cols.append(F.col("r.attributes.type").alias("type") if "type" in names else F.col("r.type").alias("type"))
    cols += [F.col(f"r.attributes.{n}").alias(n) for n in names if n != "type"]
    cols += [F.col(f"r.relationships.{rel}.data.id").alias(f"{rel}_id") for rel in TO_ONE[entity]]
    cols += [F.transform(F.col(f"r.relationships.{rel}.data"), lambda x: x["id"]).alias(f"{rel}_ids")
             for rel in TO_MANY.get(entity, [])]
    return r.select(*cols)


def _stamp(extracted_at: str | Column | None) -> Column:
    """One extraction stamp for the whole batch: the given value, else the
    landing stamp stored with the document, else the batch start time."""
    if extracted_at is not None:
        return extracted_at if isinstance(extracted_at, Column) else F.lit(extracted_at)
    return F.coalesce(F.col("_landed_at"),
                      F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def occupancy_mean(carriages: Column) -> Column:
    """Mean of the non-NULL carriage occupancy percentages, 2 decimals; NULL if none."""
    pcts = F.filter(F.transform(carriages, lambda c: c["occupancy_percentage"]), lambda x: x.isNotNull())
    total = F.aggregate(pcts, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(pcts) > 0, F.bround(total / F.size(pcts), 2))


def typed(flat: DataFrame, entity: str, extracted_at: str | Column | None = None) -> DataFrame:
    """Flat resources → the entity's declared raw schema."""
    c = F.col
    if entity == "routes":
        out = flat.select(c("id").alias("route_id"), "long_name", nullif_empty("short_name").alias("short_name"),
                          "description", "fare_class", c("type").alias("route_type"),
                          route_type_desc("type").alias("route_type_desc"), "color", "text_color",
                          "sort_order", "direction_names", "direction_destinations", "listed_route",
                          "line_id", "agency_id")
    elif entity == "stops":
        out = flat.select(c("id").alias("stop_id"), "name", "description", "latitude", "longitude",
                          "address", "municipality", "on_street", "at_street", "location_type",
                          location_type_desc("location_type").alias("location_type_desc"),
                          "vehicle_type", vehicle_type_desc("vehicle_type").alias("vehicle_type_desc"),
                          "platform_code", "platform_name", "wheelchair_boarding",
                          "parent_station_id", "zone_id")
    elif entity == "trips":
        out = flat.select(c("id").alias("trip_id"), "headsign", nullif_empty("name").alias("name"),
                          "direction_id", "block_id", "bikes_allowed", "wheelchair_accessible",
                          "revenue", "route_id", "route_pattern_id", "service_id", "shape_id")
    elif entity == "schedules":
        out = flat.select(c("id").alias("schedule_id"), "arrival_time", "departure_time", "direction_id",
                          "stop_sequence", "stop_headsign", "pickup_type", "drop_off_type",
                          "timepoint", "route_id", "stop_id", "trip_id")
    elif entity == "predictions":
        out = flat.select(c("id").alias("prediction_id"), "arrival_time", "arrival_uncertainty",
                          "departure_time", "departure_uncertainty", "direction_id", "stop_sequence",
                          "schedule_relationship", c("status").cast("string").alias("status"),
                          "revenue", "last_trip", "update_type", "route_id", "stop_id", "trip_id",
                          "vehicle_id", _stamp(extracted_at).alias("extracted_at"))
    elif entity == "vehicles":
        out = flat.select(c("id").alias("vehicle_id"), "label", "latitude", "longitude", "bearing",
                          "speed", "current_status", "current_stop_sequence", "direction_id",
                          "occupancy_status",
                          F.coalesce(F.size("carriages"), F.lit(0)).cast("int").alias("carriage_count"),
                          occupancy_mean(c("carriages")).alias("avg_occupancy_pct"), "revenue",
                          "updated_at", "route_id", "stop_id", "trip_id",
                          _stamp(extracted_at).alias("extracted_at"))
    elif entity == "alerts":
        ie = c("informed_entity")
        ids = lambda f: F.array_sort(F.array_distinct(F.filter(
            F.transform(ie, lambda e: e[f]), lambda x: x.isNotNull() & (x != ""))))
        out = flat.select(c("id").alias("alert_id"), "cause", "effect", "severity", "lifecycle", "header",
                          "description", nullif_empty("short_header").alias("short_header"),
                          "service_effect", "duration_certainty",
                          F.get(c("active_period"), 0)["start"].alias("active_start"),
                          F.get(c("active_period"), 0)["end"].alias("active_end"),
                          "created_at", "updated_at", "closed_timestamp", "url",
                          ids("route").alias("affected_routes"), ids("stop").alias("affected_stops"),
                          F.coalesce(F.size(ie), F.lit(0)).cast("int").alias("informed_entity_count"),
                          _stamp(extracted_at).alias("extracted_at"))
    else:
        raise ValueError(f"Unknown entity: {entity!r}")
    schema = getattr(S, entity.upper())
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_documents(spark: SparkSession, path: str, entity: str,
                   extracted_at: str | None = None, stream: bool = False,
                   multi_line: bool = True) -> DataFrame:
    """Landed JSON:API files of one entity → typed raw rows (``multi_line``
    for one pretty document per file, else one document per line)."""
    r = (spark.readStream if stream else spark.read).schema(document_schema(entity)).option("multiLine", multi_line)
    return typed(flatten(r.json(path), entity), entity, extracted_at)


WEATHER_VARS = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall",
                "wind_speed_10m", "wind_gusts_10m", "visibility", "weather_code"]


def weather_schema() -> T.StructType:
    hourly = [T.StructField("time", sa)] + [
        T.StructField(v, T.ArrayType(i if v == "weather_code" else d)) for v in WEATHER_VARS]
    return T.StructType([T.StructField("hourly", T.StructType(hourly))])


def weather_rows(docs: DataFrame) -> DataFrame:
    """Parallel hourly arrays → one row per ``time`` entry; shorter variable
    arrays are padded with NULL, longer ones are cut at the time axis."""
    e = docs.select(F.col("hourly").alias("h")).select(
        "h", F.posexplode_outer("h.time").alias("pos", "timestamp")).filter(F.col("timestamp").isNotNull())
    cols = [F.col("timestamp").cast("string").alias("timestamp")]
    for v in WEATHER_VARS:
        cols.append(F.try_element_at(F.col(f"h.{v}"), F.col("pos") + 1).alias(v))
    out = e.select(*cols)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.WEATHER.fields])


def read_weather(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return weather_rows(spark.read.schema(weather_schema()).option("multiLine", multi_line).json(path))


def encode_weather(raw_weather: DataFrame) -> DataFrame:
    """Hourly rows → one hourly-array document per UTC day (≤ 24 entries)."""
    day = F.substring(F.col("timestamp").cast("string"), 1, 10)
    g = raw_weather.groupBy(day.alias("day")).agg(F.array_sort(F.collect_list(F.struct(
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm").alias("time"),
        *[F.col(v) for v in WEATHER_VARS]))).alias("h"))
    def field(name):
        return lambda x: x[name]
    hourly = F.struct(F.transform("h", field("time")).alias("time"),
                      *[F.transform("h", field(v)).alias(v) for v in WEATHER_VARS])
    return g.select(hourly.alias("hourly"))


# ---------------------------------------------------------------- encoders
def encode_documents(raw: DataFrame, entity: str, resources_per_doc: int = 0) -> DataFrame:
    """Typed raw rows → JSON:API resource structs (the inverse of ``typed``
    for the fields the feed carries), one ``data`` array per partition
    bucket. Used to land documents from tables and in round-trip checks."""
    c = F.col
    names = [n for n, _ in ATTRS[entity]]
    key = {"routes": "route_id", "stops": "stop_id", "trips": "trip_id", "schedules": "schedule_id",
           "predictions": "prediction_id", "vehicles": "vehicle_id", "alerts": "alert_id"}[entity]
    attr_cols = []
    for n, t in ATTRS[entity]:
        if entity == "routes" and n == "type":
            attr_cols.append(c("route_type").alias("type"))
        elif n == "carriages":
            k = c("carriage_count")
            attr_cols.append(F.when(k > 0, F.array_repeat(F.struct(
                F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("occupancy_status"),
                c("avg_occupancy_pct").cast("int").alias("occupancy_percentage")), k))
                .cast(t).alias("carriages"))
        elif n == "active_period":
            attr_cols.append(F.array(F.struct(c("active_start").cast("string").alias("start"),
                                              c("active_end").cast("string").alias("end"))).alias(n))
        elif n == "informed_entity":
            attr_cols.append(F.concat(
                F.transform("affected_routes", lambda x: F.struct(F.lit(None).cast("string").alias("stop"), x.alias("route"),
                                                                  F.lit(None).cast("int").alias("route_type"),
                                                                  F.lit(None).cast(sa).alias("activities"))),
                F.transform("affected_stops", lambda x: F.struct(x.alias("stop"), F.lit(None).cast("string").alias("route"),
                                                                 F.lit(None).cast("int").alias("route_type"),
                                                                 F.lit(None).cast(sa).alias("activities")))).alias(n))
        else:
            attr_cols.append(c(n).cast(t).alias(n))
    rels = [F.struct(F.when(c(f"{r}_id").isNotNull(), F.struct(c(f"{r}_id").alias("id"), F.lit(r).alias("type")))
                     .alias("data")).alias(r)
            for r in TO_ONE[entity] if f"{r}_id" in raw.columns]
    item = [c(key).alias("id"), F.lit(entity[:-1]).alias("type"), F.struct(*attr_cols).alias("attributes")]
    if rels:
        item.append(F.struct(*rels).alias("relationships"))
    stamp = (c("extracted_at").cast("string") if "extracted_at" in raw.columns
             else F.lit(None).cast("string"))
    return raw.select(stamp.alias("extracted_at"), F.struct(*item).alias("r"))
