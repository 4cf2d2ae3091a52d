"""transitlake — Spark-native transit-operations analytics.

Landed snapshots of routes, stops, trips, schedules, predictions, vehicles,
alerts and weather become typed, de-duplicated tables; staging,
intermediate and mart models, the parameterised analytics queries, data
quality suites, streaming ingest and delay-prediction features are all
DataFrame / SQL / Structured Streaming / pyspark.ml jobs.
"""

__version__ = "0.1.0"
