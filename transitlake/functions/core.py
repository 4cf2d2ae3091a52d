"""Scalar column helpers shared by models, queries and features.

Everything here is a pure Catalyst expression: no Python UDFs, so the
helpers stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "round_half_away", "service_date", "service_seconds", "seconds_between",
    "day_of_week", "is_weekend", "local_time", "hour_of", "nullif_empty",
    "safe_divide", "pct", "to_ts", "epoch_seconds", "lit_ts", "avg_fixed",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_away(x, digits: int = 0) -> Column:
    """Round half away from zero, identically in every engine.

    ``sign(x) * floor(|x| * 10^d + 0.5) / 10^d`` (+0.0 folds a negative zero).
    Spark's ``round`` works on the exact decimal expansion of a double while
    other engines do not, so results are pinned to this formula.
    """
    x = _c(x)
    p = float(10 ** digits)
    return (F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)) + F.lit(0.0)


def avg_fixed(x, digits: int) -> Column:
    """Average of values that carry at most ``digits`` decimals, summed as
    exact integers (units of 10^-digits) so the result does not depend on
    summation order — any engine, any partitioning gives the same double."""
    x = _c(x)
    p = float(10 ** digits)
    return F.avg(round_half_away(x * F.lit(p), 0)) / F.lit(p)


def to_ts(x) -> Column:
    """ISO-8601 text (with or without offset), NTZ or LTZ → instant."""
    return _c(x).cast("timestamp")


def epoch_seconds(ts) -> Column:
    return _c(ts).cast("timestamp").cast("long")


def lit_ts(value) -> Column:
    """A literal instant (string 'YYYY-MM-DD HH:MM:SS' read as UTC, or datetime)."""
    return F.lit(value).cast("timestamp")


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (NULL if either is NULL)."""
    return epoch_seconds(end) - epoch_seconds(start)


def local_time(ts, tz: str = "UTC") -> Column:
    """Wall-clock time of an instant in zone ``tz`` (as a shifted timestamp)."""
    ts = _c(ts)
    return ts if tz.upper() == "UTC" else F.from_utc_timestamp(ts, tz)


def hour_of(ts, tz: str = "UTC") -> Column:
    return F.hour(local_time(ts, tz))


def service_date(ts, tz: str = "UTC", cutoff_hours: int = 3) -> Column:
    """Transit service date: local date, with times before 03:00 belonging to
    the previous day (date of local wall clock minus the cutoff)."""
    return F.to_date(local_time(ts, tz) - F.expr(f"INTERVAL {int(cutoff_hours)} HOURS"))


def service_seconds(ts, tz: str = "UTC", cutoff_hours: int = 3) -> Column:
    """Seconds since local midnight of the service day (after-midnight trips
    continue past 24h: 01:30 → 91800)."""
    lt = local_time(ts, tz)
    h = F.hour(lt)
    h = F.when(h < cutoff_hours, h + 24).otherwise(h)
    return (h * 3600 + F.minute(lt) * 60 + F.second(lt)).cast("long")


def day_of_week(d) -> Column:
    """1 = Sunday … 7 = Saturday."""
    return F.dayofweek(_c(d))


def is_weekend(d) -> Column:
    return day_of_week(d).isin(1, 7)


def nullif_empty(x) -> Column:
    x = _c(x)
    return F.when(x == F.lit(""), F.lit(None).cast("string")).otherwise(x)


def safe_divide(a, b) -> Column:
    """NULL when the denominator is 0 or NULL (never an error under ANSI)."""
    a, b = _c(a), _c(b)
    return F.when((b.isNull()) | (b == 0), F.lit(None).cast("double")).otherwise(
        a.cast("double") / b.cast("double"))


def pct(num, den) -> Column:
    """100 · num / den as DOUBLE."""
    return F.lit(100.0) * safe_divide(num, den)
