"""Registration of the model layer (staging, intermediate, marts)."""

from __future__ import annotations

from transitlake.plans.registry import register

# -- staging (D1–D8) ----------------------------------------------------------
register("d1_stg_routes", "SELECT * FROM stg_routes")(lambda m: m.stg_routes)
register("d2_stg_stops", "SELECT * FROM stg_stops")(lambda m: m.stg_stops)
register("d3_stg_trips", "SELECT * FROM stg_trips")(lambda m: m.stg_trips)
register("d4_stg_schedules", "SELECT * FROM stg_schedules")(lambda m: m.stg_schedules)
register("d5_stg_predictions", "SELECT * FROM stg_predictions")(lambda m: m.stg_predictions)
register("d6_stg_vehicles", "SELECT * FROM stg_vehicles")(lambda m: m.stg_vehicles)
register("d7_stg_alerts", "SELECT * FROM stg_alerts")(lambda m: m.stg_alerts)
register("d8_stg_weather", "SELECT * FROM stg_weather")(lambda m: m.stg_weather)

# -- intermediate (E1–E4) ----------------------------------------------------
register("e1_scheduled_vs_actual", "SELECT * FROM int_scheduled_vs_actual")(
    lambda m: m.scheduled_vs_actual)
register("e2_stop_activity", "SELECT * FROM int_stop_activity")(lambda m: m.stop_activity)
register("e3_alert_impacts", "SELECT * FROM int_alert_impacts")(lambda m: m.alert_impacts)
register("e4_weather_transit", "SELECT * FROM int_weather_transit")(lambda m: m.weather_transit)

# -- marts (F1–F4) -----------------------------------------------------------
register("f1_route_reliability", "SELECT * FROM mart_route_reliability")(
    lambda m: m.route_reliability)
register("f2_stop_performance", "SELECT * FROM mart_stop_performance")(
    lambda m: m.stop_performance)
register("f3_delay_analysis", "SELECT * FROM mart_delay_analysis")(lambda m: m.delay_analysis)
register("f4_alert_summary", "SELECT * FROM mart_alert_summary")(lambda m: m.alert_summary)
from transitlake.plans import catalog_queries  # noqa: F401,E402
from transitlake.plans import catalog_ops  # noqa: F401,E402
from transitlake.plans import catalog_streams  # noqa: F401,E402
from transitlake.plans import catalog_sources  # noqa: F401,E402
from transitlake.plans import catalog_derived  # noqa: F401,E402
from transitlake.plans import catalog_ml  # noqa: F401,E402
from transitlake.plans import catalog_explore  # noqa: F401,E402
from transitlake.plans import catalog_pairs  # noqa: F401,E402
from transitlake.plans import catalog_incremental  # noqa: F401,E402
from transitlake.plans import catalog_stores  # noqa: F401,E402
