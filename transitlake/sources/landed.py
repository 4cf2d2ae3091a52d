"""Landed inputs: recursive Parquet scans, JSON:API documents, weather
arrays, the mode seed and typed empty frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from transitlake.functions.labels import ROUTE_TYPE_CATEGORY, ROUTE_TYPE_NAMES
from transitlake.sources.schemas import ROUTE_TYPE_MAPPING


def route_type_seed(spark: SparkSession) -> DataFrame:
    """The five-row mode seed (route_type, name, category)."""
    rows = [(k, ROUTE_TYPE_NAMES[k], ROUTE_TYPE_CATEGORY[k]) for k in sorted(ROUTE_TYPE_NAMES)]
    return spark.createDataFrame(rows, ROUTE_TYPE_MAPPING)


def read_seed(spark: SparkSession, path: str, schema: T.StructType = ROUTE_TYPE_MAPPING) -> DataFrame:
    """A headed seed CSV in its declared types (A8); a header that names other columns is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Typed empty frame for an entity with no input."""
    return spark.createDataFrame([], schema)


def mode_route_ids(routes: DataFrame, route_type: int = 3) -> DataFrame:
    """A10: ids of one mode (default: bus), ordered."""
    from pyspark.sql import functions as F
    return routes.filter(F.col("route_type") == route_type).select("route_id").orderBy("route_id")
