"""Table writes used by the batch DAG (model materialisation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_for_partitioned_write(df: DataFrame, partition_by: Sequence[str],
                                  cluster_by: Sequence[str] = ()) -> DataFrame:
    """Range-cluster rows by (partition columns, cluster keys) before a
    ``partitionBy`` write.

    A hash-distributed frame holds rows of every partition value in every
    task, so a partitioned write makes tasks × values small files (a
    multi-year snapshot table: thousands of files per load). A range
    exchange on (partition columns, keys) gives each task a contiguous run
    of partition values, about one file per value, and still splits a hot
    value over several tasks by the key. Without keys, a row hash is the
    tie-breaker so a hot value is split all the same. Rows are sorted by
    the same columns inside each task, which the partitioned writer needs
    anyway and which keeps row-group min/max tight on the keys. The number
    of ranges follows ``spark.sql.shuffle.partitions`` and AQE coalesces
    small ones.
    """
    if not partition_by:
        return df
    tail = [F.col(c) for c in cluster_by] or [F.xxhash64(*[F.col(c) for c in df.columns])]
    order = [F.col(c) for c in partition_by] + tail
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_model(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                cluster_by: Sequence[str] = ()) -> str:
    """Materialise a model as Parquet: optional partition columns, rows
    clustered (sorted within files) so min/max statistics prune scans."""
    if partition_by:
        w = cluster_for_partitioned_write(df, partition_by, cluster_by)
    elif cluster_by:
        w = df.sortWithinPartitions(*cluster_by)
    else:
        w = df
    writer = w.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


# Databases of the model layers (fixed values of the source).
LAYERS = {"stg": "staging", "int": "intermediate", "mart": "marts"}


def database_of(model: str, default: str = "default", layers: dict[str, str] | None = None) -> str:
    """S3: the database of a model by its layer; a layer without a name of its own takes the target's default."""
    named = (LAYERS if layers is None else layers).get(model.split("_", 1)[0])
    return named.strip() if named and named.strip() else default


def publish(df: DataFrame, model: str, root: str, default: str = "default",
            layers: dict[str, str] | None = None) -> str:
    """Write a model as a catalog table in its database under ``root``; returns the qualified name."""
    spark, db = df.sparkSession, database_of(model, default, layers)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}` LOCATION '{root.rstrip('/')}/{db}'")
    df.write.mode("overwrite").option("path", f"{root.rstrip('/')}/{db}/{model}").saveAsTable(f"`{db}`.`{model}`")
    return f"{db}.{model}"
