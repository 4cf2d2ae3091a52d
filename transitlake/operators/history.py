"""Table statistics kept run by run, their drift, and freshness by landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.functions.core import lit_ts, round_half_away
from transitlake.operators.quality import FRESHNESS_DEFAULT_HOURS, FRESHNESS_HOURS

MAX_CHANGE_PCT = 50.0


def measure(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, metric, value): rows of each table and NULLs of each column, one pass a table."""
    out = None
    for name, df in tables.items():
        marks = [F.struct(F.lit("rows").alias("metric"), F.count(F.lit(1)).alias("value"))]
        marks += [F.struct(F.lit(f"nulls:{c}").alias("metric"), F.count_if(F.col(c).isNull()).alias("value"))
                  for c in df.columns]
        one = df.agg(F.array(*marks).alias("m")).select(F.lit(name).alias("table_name"), F.explode("m").alias("m"))
        one = one.select("table_name", "m.metric", "m.value")
        out = one if out is None else out.unionByName(one)
    return out


class StatsHistory:
    """Statistics of every run under one folder; a repeated run replaces its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, tables: dict[str, DataFrame], run: int) -> None:
        measure(tables).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={int(run)}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drift(self, max_change_pct: float = MAX_CHANGE_PCT) -> DataFrame:
        """Each metric of the latest run against the run before it.

        A metric that was zero or absent before has no relative change and
        fails only if it is a row count that went to zero; a table that the
        latest run lacks has zero rows.
        """
        runs = self.rows().select("run").distinct().orderBy(F.col("run").desc()).limit(2).collect()
        if not runs:
            raise ValueError("no run is recorded")
        now = self.rows().filter(F.col("run") == runs[0][0]).drop("run")
        before = self.rows().filter(F.col("run") == (runs[1][0] if len(runs) > 1 else -1)).select(
            "table_name", "metric", F.col("value").alias("previous"))
        j = now.join(before, ["table_name", "metric"], "full_outer").withColumn("value", F.coalesce("value", F.lit(0)))
        change = F.when(F.col("previous") > 0, (F.col("value") - F.col("previous")) * 100.0 / F.col("previous"))
        gone = (F.col("metric") == "rows") & (F.col("value") == 0)
        return j.select("table_name", "metric", "value", "previous", round_half_away(change, 1).alias("change_pct"),
                        (~gone & F.coalesce(F.abs(change) <= max_change_pct, F.lit(True))).alias("passed"))


def file_freshness(spark: SparkSession, paths: dict[str, str], now: Column | str | None = None) -> DataFrame:
    """Age of the newest landed file of each table against the table's limit.

    The landing instant is the modification time that the file system keeps
    (``_metadata``); no column is read. A table without files is missing.
    """
    at = F.current_timestamp() if now is None else now if isinstance(now, Column) else lit_ts(now)
    out = None
    for name, path in paths.items():
        limit = FRESHNESS_HOURS.get(name, FRESHNESS_DEFAULT_HOURS)
        newest = F.max("_metadata.file_modification_time")
        age = (at.cast("long") - newest.cast("long")) / 3600.0
        row = spark.read.option("recursiveFileLookup", "true").parquet(path).agg(newest.alias("landed_at"), F.struct(
            F.coalesce(age <= limit, F.lit(False)).alias("passed"),
            F.coalesce(round_half_away(age, 2).cast("string"), F.lit("missing")).alias("actual")).alias("r"))
        row = row.select(F.lit(name).alias("entity"), F.lit("file_freshness").alias("check"), "r.passed",
                         F.lit(f"<= {limit} h").alias("expected"), "r.actual", "landed_at")
        out = row if out is None else out.unionByName(row)
    return out
