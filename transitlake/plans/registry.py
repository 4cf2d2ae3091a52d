"""Registry of runnable queries: key → (Spark job, DuckDB oracle SQL).

Keys are ``<inventory id>_<name>``. Every job takes ``(spark, sf_dir)``,
derives the canonical tables from the driver's parquet tables and returns
a DataFrame over the whole data (no row caps except where a top-k *is*
the query). Timestamp outputs are handed over as wall-clock UTC
(``timestamp_ntz``) so the result means the same in any client zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transitlake.plans.models import Models
from transitlake.plans.oracle_sql import with_models

SparkJob = Callable[[SparkSession, str], DataFrame]

_JOBS: dict[str, SparkJob] = {}
_SQL: dict[str, str] = {}
_MODEL_FNS: dict[str, Callable] = {}
_FINAL_SQL: dict[str, str] = {}


def utc_wallclock(df: DataFrame) -> DataFrame:
    """Top-level instants → UTC wall-clock ``timestamp_ntz`` columns."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def register(key: str, sql: str | None = None, models_sql: bool = True):
    """Decorator: ``fn(m: Models) -> DataFrame`` becomes a registered job."""
    def deco(fn):
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            return utc_wallclock(fn(Models.from_dir(spark, sf_dir)))
        job.__name__ = key
        job.__doc__ = fn.__doc__
        _JOBS[key] = job
        _MODEL_FNS[key] = fn
        if sql is not None:
            _SQL[key] = with_models(sql) if models_sql else sql
            _FINAL_SQL[key] = sql
        return fn
    return deco


def final_sql(key: str) -> str:
    """The registered oracle statement of ``key`` without the model CTEs."""
    return _FINAL_SQL[key]


def register_raw(key: str, sql: str | None = None):
    """Decorator for jobs that need the session and data dir directly."""
    def deco(fn):
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            return utc_wallclock(fn(spark, sf_dir))
        job.__name__ = key
        _JOBS[key] = job
        if sql is not None:
            _SQL[key] = with_models(sql)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from transitlake.plans import catalog  # noqa: F401


def jobs() -> dict[str, SparkJob]:
    _load_all()
    return dict(_JOBS)


def model_functions() -> dict[str, Callable]:
    """``Models -> DataFrame`` form of the model-based jobs (reuse one
    ``Models`` — e.g. over landed tables — across many queries)."""
    _load_all()
    return dict(_MODEL_FNS)


def oracle() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
