"""Round trips through the document readers.

Derived raw tables are encoded as feed documents (JSON:API resources; one
hourly-array document per day for weather), landed as JSON lines under the
shared checkpoint folder, and read back through the real parsers. The
result must equal the source table (times pass through as ISO text and are
typed again by staging).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transitlake.plans import staging
from transitlake.plans.registry import register_raw
from transitlake.session import checkpoint_dir
from transitlake.sources import documents as docs
from transitlake.sources.proxy import RawTables


def _land(df, spark, name: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/transitlake-docs/{name}-{uuid.uuid4().hex[:8]}"
    # Compressed as a feed is landed: the names of all fields stand in every document.
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path, compression="gzip")
    return path


register_raw("a4_jsonapi_routes_roundtrip", "SELECT * REPLACE (NULLIF(short_name, '') AS short_name) FROM raw_routes")(
    lambda spark, d: docs_roundtrip(spark, d, "routes"))
register_raw("a4b_jsonapi_stops_roundtrip", "SELECT * FROM raw_stops")(
    lambda spark, d: docs_roundtrip(spark, d, "stops"))
register_raw("b6_vehicle_documents_to_staging", "SELECT * FROM stg_vehicles")(
    lambda spark, d: staging.stg_vehicles(docs_roundtrip(spark, d, "vehicles")))
# A landed alert counts its informed entities (one per route and per stop
# here); the proxy's own count column is not carried by the document.
register_raw("a5_alert_documents_to_staging",
             "SELECT * REPLACE (CAST(len(affected_routes) + len(affected_stops) AS INTEGER) "
             "AS informed_entity_count) FROM stg_alerts")(
    lambda spark, d: staging.stg_alerts(docs_roundtrip(spark, d, "alerts")))
register_raw("a6_weather_documents_to_staging", "SELECT * FROM stg_weather")(
    lambda spark, d: staging.stg_weather(weather_roundtrip(spark, d)))


def docs_roundtrip(spark, sf_dir, entity):
    raw = getattr(RawTables(spark, sf_dir), entity)
    res = docs.encode_documents(raw, entity)          # (extracted_at, r): one resource per row
    landed = res.select("extracted_at", F.array("r").alias("data"))
    path = _land(landed, spark, entity)
    return docs.read_documents(spark, path, entity, multi_line=False)


def weather_roundtrip(spark, sf_dir):
    raw = RawTables(spark, sf_dir).weather
    path = _land(docs.encode_weather(raw), spark, "weather")
    return docs.read_weather(spark, path, multi_line=False)
