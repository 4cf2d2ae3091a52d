"""A store of fitted models: one fit per training data and settings.

A fit is known by the fingerprint of its training frame (row count and an
order-free sum of row hashes) and of the estimator's settings. Model,
predictions on the test rows and feature importances are written once under
the session's shared folder; every evaluation reads them, and a second request
for the same fit only looks the folder up. A fit is written beside its place
and moved there whole, so a reader never sees half of one, and of two writers
the first wins.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.plans import learning as L
from transitlake.session import checkpoint_dir


@dataclass(frozen=True)
class Fit:
    """Where a fit lies; ``fresh`` tells whether this call made it."""

    spark: SparkSession
    path: str
    fresh: bool

    @property
    def predictions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/predictions")

    @property
    def importances(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/importances")

    @property
    def model(self) -> PipelineModel:
        return PipelineModel.load(f"{self.path}/model")


def fingerprint(data: DataFrame) -> str:
    """Row count and sum of row hashes: equal for equal rows in any order or partitioning."""
    cols = sorted(data.columns)
    n, total = data.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{cols}:{n}:{total}".encode()).hexdigest()


def settings(estimator) -> str:
    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    return f"{type(estimator).__name__}:{sorted(params.items())}"


class FitStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{checkpoint_dir(spark).rstrip('/')}/fits").rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def fit(self, data: DataFrame, estimator, of: str | None = None) -> Fit:
        """The fit of ``estimator`` on the rows of ``data`` that are not ``is_test``.

        ``of`` is the data's fingerprint where the caller has it already.
        """
        key = hashlib.sha256(f"{of or fingerprint(data)}|{settings(estimator)}".encode()).hexdigest()[:24]
        path = f"{self.root}/{type(estimator).__name__}-{key}"
        fs, place = self._fs(path)
        if fs.exists(place):
            return Fit(self.spark, path, False)
        new = f"{path}.new-{uuid.uuid4().hex[:8]}"
        model, pred = L.fit_model(data, estimator)
        vectors = [f.name for f in pred.schema.fields if isinstance(f.dataType, T.UserDefinedType)]
        L.late_probability(pred).drop(*vectors).write.parquet(f"{new}/predictions")
        model.write().save(f"{new}/model")
        if hasattr(model.stages[-1], "featureImportances"):
            L.importance_table(model).coalesce(1).write.parquet(f"{new}/importances")
        fs, made = self._fs(new)
        if not fs.rename(made, place) and not fs.exists(place):
            raise OSError(f"{new} could not be moved to {path}")
        return Fit(self.spark, path, True)
