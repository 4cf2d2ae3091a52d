"""The model graph over one set of raw tables.

``Models`` wires staging → intermediate → marts lazily; each attribute is a
DataFrame (a logical plan), built once per instance. ``materialize`` writes
the heavy shared intermediate (scheduled-vs-actual, read by four marts and
many queries), on request partitioned by service date, as a batch job would.
The delay marts read it without the columns that they have no use for; they
are dropped before the latest-per-key aggregate.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlake.plans import intermediate as inter
from transitlake.plans import marts, staging
from transitlake.session import stored
from transitlake.sources.proxy import RawTables


#: Columns of predictions that reach a delay mart.
MART_PREDICTION_COLS = ("route_id", "stop_id", "trip_id", "direction_id", "predicted_arrival", "predicted_departure")
#: Columns of predictions that reach the feature matrix.
FEATURE_PREDICTION_COLS = ("prediction_id", "trip_id", "route_id", "stop_id", "direction_id", "stop_sequence",
                           "extracted_at", "arrival_uncertainty", "departure_uncertainty", "predicted_arrival",
                           "predicted_departure")


class Models:
    def __init__(self, raw: RawTables, tz: str = "UTC", local_hours: bool = False):
        self.raw = raw
        self.spark: SparkSession = raw.spark
        self.tz = tz
        self.local_hours = local_hours
        self._written: set[str] = set()

    @classmethod
    def from_dir(cls, spark: SparkSession, sf_dir: str, **kw) -> "Models":
        return cls(RawTables(spark, sf_dir), **kw)

    # staging
    @cached_property
    def stg_routes(self) -> DataFrame:
        return staging.stg_routes(self.raw.routes)

    @cached_property
    def stg_stops(self) -> DataFrame:
        return staging.stg_stops(self.raw.stops)

    @cached_property
    def stg_trips(self) -> DataFrame:
        return staging.stg_trips(self.raw.trips)

    @cached_property
    def stg_schedules(self) -> DataFrame:
        return staging.stg_schedules(self.raw.schedules)

    @cached_property
    def stg_predictions(self) -> DataFrame:
        return staging.stg_predictions(self.raw.predictions)

    @cached_property
    def stg_vehicles(self) -> DataFrame:
        return staging.stg_vehicles(self.raw.vehicles)

    @cached_property
    def stg_alerts(self) -> DataFrame:
        return staging.stg_alerts(self.raw.alerts)

    @cached_property
    def stg_weather(self) -> DataFrame:
        return staging.stg_weather(self.raw.weather)

    # intermediate
    @cached_property
    def scheduled_vs_actual(self) -> DataFrame:
        return inter.scheduled_vs_actual(self.stg_predictions, self.stg_schedules,
                                         self.stg_routes, self.stg_stops, self.tz, latest=True)

    @cached_property
    def stop_activity(self) -> DataFrame:
        return inter.stop_activity(self.stg_vehicles, self.stg_stops, self.stg_routes)

    @cached_property
    def alert_impacts(self) -> DataFrame:
        return inter.alert_impacts(self.stg_alerts)

    @cached_property
    def weather_transit(self) -> DataFrame:
        return inter.weather_transit(self.scheduled_vs_actual, self.stg_weather)

    # marts
    @cached_property
    def _mart_delays(self) -> DataFrame:
        """Delays for the marts: the written table if there is one, else without columns they don't read."""
        if "scheduled_vs_actual" in self._written:
            return self.scheduled_vs_actual
        return self._narrow_delays(MART_PREDICTION_COLS)

    def _narrow_delays(self, columns) -> DataFrame:
        narrow = staging.stg_predictions(self.raw.predictions, columns)
        return inter.scheduled_vs_actual(narrow, self.stg_schedules, self.stg_routes, self.stg_stops, self.tz, latest=True)

    @cached_property
    def feature_delays(self) -> DataFrame:
        """Delays with the columns of the feature matrix, stored once for its histories and its rows."""
        delays = (self.scheduled_vs_actual if "scheduled_vs_actual" in self._written
                  else self._narrow_delays(FEATURE_PREDICTION_COLS))
        return stored(delays.filter(F.col("delay_seconds").isNotNull()).select(
            *FEATURE_PREDICTION_COLS, "delay_seconds", "is_late"))

    @cached_property
    def route_reliability(self) -> DataFrame:
        return marts.route_reliability(self._mart_delays)

    @cached_property
    def stop_performance(self) -> DataFrame:
        return marts.stop_performance(self._mart_delays, self.stop_activity)

    @cached_property
    def delay_analysis(self) -> DataFrame:
        return marts.delay_analysis(self._mart_delays, self.tz, self.local_hours)

    @cached_property
    def alert_summary(self) -> DataFrame:
        return marts.alert_summary(self.alert_impacts)

    CLUSTER = {"scheduled_vs_actual": ("route_id", "stop_id", "direction_id"),
               "weather_transit": ("route_id", "stop_id")}

    def materialize(self, root: str, names=("scheduled_vs_actual",),
                    partition_by_date: bool = False) -> "Models":
        """Write the named models under ``root`` and read them back, cutting
        lineage (the written table is the recovery point if executors die).

        Rows are clustered by the model's cluster keys; ``partition_by_date``
        adds a ``service_date`` directory level (use it for daily incremental
        runs, not for multi-year backfills, which would scatter tiny files).
        """
        from transitlake.operators.tables import write_model
        for name in names:
            df = getattr(self, name)
            path = f"{root.rstrip('/')}/{name}"
            part = ("service_date",) if partition_by_date and "service_date" in df.columns else ()
            write_model(df, path, partition_by=part, cluster_by=self.CLUSTER.get(name, ()))
            self.__dict__[name] = self.spark.read.parquet(path)
            self._written.add(name)
            for mart in ("_mart_delays", "feature_delays", "route_reliability", "stop_performance", "delay_analysis"):
                self.__dict__.pop(mart, None)
        return self
