"""Code → label rules and classification thresholds.

Fixed values that must equal the source system's published behaviour are
kept together below, in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away

__all__ = [
    "ROUTE_TYPE_NAMES", "ROUTE_TYPE_CATEGORY", "LOCATION_TYPE_NAMES", "VEHICLE_TYPE_NAMES",
    "WEATHER_CODE_GROUPS", "DAY_NAMES", "ALERT_EFFECT_MULTIPLIER",
    "label", "route_type_desc", "location_type_desc", "vehicle_type_desc",
    "weather_condition", "severity_category", "time_period", "delay_category",
    "day_name", "reliability_label", "health_label", "risk_level", "delay_bucket",
    "stop_position_bin", "search_location_desc",
]

# ---------------------------------------------------------------------------
# Fixed values (must match the source feed / reference behaviour exactly)
# ---------------------------------------------------------------------------
ROUTE_TYPE_NAMES = {0: "Light Rail", 1: "Heavy Rail", 2: "Commuter Rail", 3: "Bus", 4: "Ferry"}
ROUTE_TYPE_CATEGORY = {0: "Rail", 1: "Rail", 2: "Rail", 3: "Bus", 4: "Ferry"}
LOCATION_TYPE_NAMES = {0: "Stop/Platform", 1: "Station", 2: "Entrance/Exit", 3: "Generic Node"}
VEHICLE_TYPE_NAMES = {0: "Light Rail", 1: "Heavy Rail", 2: "Commuter Rail", 3: "Bus", 4: "Ferry"}
# Weather code groups, staging variant (code 1 is Cloudy).
WEATHER_CODE_GROUPS = [
    ("Clear", (0,)),
    ("Cloudy", (1, 2, 3)),
    ("Fog", (45, 48)),
    ("Drizzle", (51, 53, 55, 56, 57)),
    ("Rain", (61, 63, 65, 66, 67)),
    ("Snow", (71, 73, 75, 77)),
    ("Rain Showers", (80, 81, 82)),
    ("Snow Showers", (85, 86)),
    ("Thunderstorm", (95, 96, 99)),
]
DAY_NAMES = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday",
             6: "Friday", 7: "Saturday"}
# Alert impact multiplier by effect (mart formula); everything else 1.0.
ALERT_EFFECT_MULTIPLIER = [
    (2.0, ("SUSPENSION", "DETOUR", "STOP_CLOSURE")),
    (1.5, ("DELAY", "SERVICE_CHANGE")),
    (1.2, ("STATION_ISSUE", "STOP_MOVED")),
]
# Delay category upper bounds (seconds, right-closed); above the last: very_late.
DELAY_CATEGORY_BOUNDS = [(-60, "early"), (60, "on_time"), (300, "slightly_late"), (600, "late")]
# Time period by hour of day (inclusive ranges); otherwise overnight.
TIME_PERIODS = [((6, 9), "morning_rush"), ((10, 15), "midday"), ((16, 19), "evening_rush"),
                ((20, 23), "evening")]
# Severity class thresholds: (critical, major, minor) lower bounds.
SEVERITY_MART = (7, 4, 2, "informational")
SEVERITY_LIVE = (7, 4, 1, "info")
# Model-evaluation delay buckets (right-closed edges, seconds).
DELAY_BUCKET_EDGES = [(-300, "very_early"), (-60, "early"), (60, "on_time"),
                      (300, "slightly_late"), (600, "late")]
DELAY_BUCKET_LAST = "very_late"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label(code, mapping: dict, default=None) -> Column:
    """``CASE code WHEN k THEN v … ELSE default END`` as a when-chain."""
    code = _c(code)
    out = None
    for k, v in mapping.items():
        out = F.when(code == F.lit(k), F.lit(v)) if out is None else out.when(code == F.lit(k), F.lit(v))
    d = F.lit(default).cast("string")
    return out.otherwise(d) if out is not None else d


def route_type_desc(code) -> Column:
    return label(code, ROUTE_TYPE_NAMES, "Unknown")


def location_type_desc(code) -> Column:
    return label(code, LOCATION_TYPE_NAMES, "Unknown")


def vehicle_type_desc(code) -> Column:
    """Vehicle label; NULL when the code is NULL, 'Unknown' for other codes."""
    code = _c(code)
    return F.when(code.isNull(), F.lit(None).cast("string")).otherwise(
        label(code, VEHICLE_TYPE_NAMES, "Unknown"))


def weather_condition(code, variant: str = "staging") -> Column:
    """Weather-code class. ``variant='current'`` treats code 1 as Clear."""
    code = _c(code)
    groups = [(n, tuple(c)) for n, c in WEATHER_CODE_GROUPS]
    if variant == "current":
        groups[0] = ("Clear", (0, 1))
        groups[1] = ("Cloudy", (2, 3))
    out = None
    for name, codes in groups:
        cond = code.isin(*codes)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("Unknown"))


def severity_category(sev, variant: str = "mart") -> Column:
    """Severity class: mart ≥7/4/2 else informational; live ≥7/4/1 else info."""
    crit, major, minor, low = SEVERITY_MART if variant == "mart" else SEVERITY_LIVE
    sev = _c(sev)
    return (F.when(sev >= crit, F.lit("critical")).when(sev >= major, F.lit("major"))
            .when(sev >= minor, F.lit("minor")).otherwise(F.lit(low)))


def time_period(hour) -> Column:
    hour = _c(hour)
    out = None
    for (lo, hi), name in TIME_PERIODS:
        cond = hour.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("overnight"))


def delay_category(delay) -> Column:
    delay = _c(delay)
    out = F.when(delay.isNull(), F.lit("unknown"))
    for bound, name in DELAY_CATEGORY_BOUNDS:
        out = out.when(delay <= bound, F.lit(name))
    return out.otherwise(F.lit("very_late"))


def day_name(dow) -> Column:
    return label(dow, DAY_NAMES, None)


def reliability_label(score) -> Column:
    s = _c(score)
    return (F.when(s >= 85, F.lit("High")).when(s >= 70, F.lit("Good"))
            .when(s >= 55, F.lit("Fair")).otherwise(F.lit("Poor")))


def health_label(on_time_pct) -> Column:
    s = _c(on_time_pct)
    return F.when(s >= 85, F.lit("Good")).when(s >= 70, F.lit("Fair")).otherwise(F.lit("Poor"))


def risk_level(pct) -> Column:
    s = _c(pct)
    return F.when(s >= 40, F.lit("HIGH")).when(s >= 20, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def delay_bucket(delay) -> Column:
    d = _c(delay)
    out = None
    for edge, name in DELAY_BUCKET_EDGES:
        out = F.when(d <= edge, F.lit(name)) if out is None else out.when(d <= edge, F.lit(name))
    return out.otherwise(F.lit(DELAY_BUCKET_LAST))


def stop_position_bin(seq) -> Column:
    s = _c(seq)
    return F.when(s <= 5, F.lit("early")).when(s <= 15, F.lit("middle")).otherwise(F.lit("late"))


def search_location_desc(location_type) -> Column:
    lt = _c(location_type)
    return F.when(lt == 1, F.lit("Station")).when(lt == 0, F.lit("Stop")).otherwise(F.lit("Node"))


def delay_status(minutes, compact: bool = False) -> Column:
    """Size of a delay in minutes with its direction; under 0.05 minutes is on time."""
    m = _c(minutes)
    size = F.abs(m)
    word = F.when(size < 0.05, F.lit("on time")).when(m < 0, F.lit("early")).otherwise(F.lit("delayed"))
    shown = F.when(size < 0.05, F.lit("0.0")).otherwise(round_half_away(size, 1).cast("decimal(18,1)").cast("string"))
    return F.concat_ws(" ", shown, word) if compact else F.concat_ws(" ", shown, F.lit("min"), word)
