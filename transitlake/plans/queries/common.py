from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away as rha

DEFAULT_COLOR = "7F7F7F"


def minutes(x, digits: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return rha(x / 60.0, digits)


def opt_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Optional equality filter: ``'all'``/``''``/``None`` means no filter."""
    if value is None or str(value).lower() in ("all", ""):
        return df
    return df.filter(F.col(col) == F.lit(value))


def route_color(col: str = "color") -> Column:
    return F.coalesce(F.col(col), F.lit(DEFAULT_COLOR))


def top(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """Top-``n`` by ``order``; ``n=None`` keeps every row (ordered)."""
    df = df.orderBy(*order)
    return df if n is None else df.limit(int(n))
