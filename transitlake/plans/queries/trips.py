"""Trip planning queries.

Route finding (N36) never materialises trip pairs. For a transfer through
stop group *g* from route *r1* to route *r2*, the valid first legs and the
valid second legs are independent given (r1, r2, g) — the only cross-leg
condition, r1 ≠ r2, is part of the key — so the trip pairs are the product
T1(r1, g) × T2(r2, g). Each side is therefore aggregated on its own
(distinct trips, earliest departure / arrival) and the two per-(route,
group) aggregates are joined on g: ``matching_trips = |T1| · |T2|``,
exactly the distinct pair count, with no per-pair rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.functions.core import round_half_away as rha, safe_divide
from transitlake.functions.labels import search_location_desc
from transitlake.plans.queries.common import minutes, route_color, top

ROUTE_ATTRS = ("route_name", "route_type", "route_type_desc", "route_color")


def _places(m) -> DataFrame:
    return m.raw.stops.select(
        "stop_id", "parent_station_id",
        F.coalesce("parent_station_id", "stop_id").alias("stop_group"),
        F.col("name").alias("stop_name"))


def _calls(m) -> DataFrame:
    s = m.raw.schedules.filter(F.col("departure_time").isNotNull()).select(
        "trip_id", "route_id", "stop_id", "direction_id", "stop_sequence", "arrival_time",
        "departure_time")
    r = F.broadcast(m.raw.routes.select(
        "route_id", F.col("long_name").alias("route_name"), "route_type", "route_type_desc",
        route_color().alias("route_color")))
    return (s.join(_places(m).select("stop_id", "stop_group", "stop_name"), "stop_id")
             .join(r, "route_id"))


def _matching(lookup: DataFrame, stop: str) -> DataFrame:
    """Stops equal to ``stop`` or children of it (two equi-lookups, no OR join)."""
    return lookup.filter((F.col("stop_id") == stop) | (F.col("parent_station_id") == stop)).select("stop_id")


def _legs(se: DataFrame, board: DataFrame | None, alight: DataFrame | None,
          board_alias: str, alight_alias: str) -> DataFrame:
    """(boarding visit, later visit of the same trip) pairs; ``board`` /
    ``alight`` restrict the boarding / alighting stops (semi joins).

    The unrestricted side is first cut to the trips that pass the
    restricted stops (semi join on trip id), so only the visits of those
    trips — never the whole schedule — reach the pairing join's shuffle.
    """
    b = se.join(board, "stop_id", "left_semi") if board is not None else None
    a = se.join(alight, "stop_id", "left_semi") if alight is not None else None
    if b is None:
        b = se.join(a.select("trip_id").distinct(), "trip_id", "left_semi")
    if a is None:
        a = se.join(b.select("trip_id").distinct(), "trip_id", "left_semi")
    b = b.select(*[F.col(c).alias(f"{board_alias}_{c}") for c in se.columns])
    a = a.select(*[F.col(c).alias(f"{alight_alias}_{c}") for c in se.columns])
    return b.join(a, (F.col(f"{board_alias}_trip_id") == F.col(f"{alight_alias}_trip_id"))
                  & (F.col(f"{board_alias}_route_id") == F.col(f"{alight_alias}_route_id"))
                  & (F.col(f"{board_alias}_direction_id") == F.col(f"{alight_alias}_direction_id"))
                  & (F.col(f"{board_alias}_stop_sequence") < F.col(f"{alight_alias}_stop_sequence")))


def find_routes(m, origin: str, dest: str, preferred_pair: tuple | None = None,
                limit: int = 25) -> DataFrame:
    """Direct and one-transfer route options between two stops/stations."""
    lookup = _places(m)
    se = _calls(m)
    o_stops, d_stops = _matching(lookup, origin), _matching(lookup, dest)

    # Route attributes depend on the route id alone, so they are grouping
    # keys (hash aggregation) rather than min()/any_value() of strings.
    direct = (_legs(se, o_stops, d_stops, "o", "d")
              .filter(F.col("d_arrival_time").isNotNull())
              .groupBy(F.col("o_route_id").alias("first_route_id"),
                       *[F.col(f"o_{c}").alias(f"first_{c}") for c in ROUTE_ATTRS])
              .agg(F.min("o_departure_time").alias("first_departure"),
                   F.min("d_arrival_time").alias("final_arrival"),
                   F.countDistinct("o_trip_id").alias("matching_trips")))
    direct = direct.select(
        F.lit("direct").alias("connection_type"), F.lit(0).alias("transfers"), "first_route_id",
        *[F.col(f"first_{c}") for c in ROUTE_ATTRS],
        F.lit(None).cast("string").alias("second_route_id"),
        F.lit(None).cast("string").alias("second_route_name"),
        F.lit(None).cast("int").alias("second_route_type"),
        F.lit(None).cast("string").alias("second_route_type_desc"),
        F.lit(None).cast("string").alias("second_route_color"),
        F.lit(None).cast("string").alias("transfer_stop_id"),
        F.lit(None).cast("string").alias("transfer_stop_name"),
        "first_departure", "final_arrival", "matching_trips")

    first = (_legs(se, o_stops, None, "l1", "t")
             .filter(F.col("t_arrival_time").isNotNull())
             .groupBy(F.col("l1_route_id").alias("first_route_id"),
                      F.col("t_stop_group").alias("transfer_stop_id"),
                      *[F.col(f"l1_{c}").alias(f"first_{c}") for c in ROUTE_ATTRS])
             .agg(F.array_min(F.collect_set("t_stop_name")).alias("transfer_stop_name"),
                  F.min("l1_departure_time").alias("first_departure"),
                  F.countDistinct("l1_trip_id").alias("n1")))
    second = (_legs(se, None, d_stops, "l2", "d")
              .filter(F.col("d_arrival_time").isNotNull() & F.col("l2_departure_time").isNotNull())
              .groupBy(F.col("l2_route_id").alias("second_route_id"),
                       F.col("l2_stop_group").alias("transfer_stop_id"),
                       *[F.col(f"l2_{c}").alias(f"second_{c}") for c in ROUTE_ATTRS])
              .agg(F.min("d_arrival_time").alias("final_arrival"),
                   F.countDistinct("l2_trip_id").alias("n2")))
    transfer = first.join(second, "transfer_stop_id").filter(
        F.col("first_route_id") != F.col("second_route_id"))
    transfer = transfer.select(
        F.lit("transfer").alias("connection_type"), F.lit(1).alias("transfers"), "first_route_id",
        *[F.col(f"first_{c}") for c in ROUTE_ATTRS], "second_route_id",
        *[F.col(f"second_{c}") for c in ROUTE_ATTRS], "transfer_stop_id", "transfer_stop_name",
        "first_departure", "final_arrival", (F.col("n1") * F.col("n2")).alias("matching_trips"))

    ranked = direct.unionByName(transfer)
    pref = F.lit(1)
    if preferred_pair:
        pref = F.when((F.col("first_route_id") == preferred_pair[0])
                      & (F.col("second_route_id") == preferred_pair[1]), 0).otherwise(1)
    return top(ranked, limit, F.col("transfers").asc(), F.col("matching_trips").desc(), pref,
               F.col("first_route_type").asc_nulls_first(), F.col("first_route_id").asc_nulls_first(),
               F.col("second_route_id").asc_nulls_first(), F.col("transfer_stop_id").asc_nulls_first())


def route_reliability(m, route_ids: list[str]) -> DataFrame:
    """Trip-planner reliability per route: on time ≤ 120 s, risk > 300 s."""
    return _reliability(m.scheduled_vs_actual.filter(F.col("route_id").isin(*route_ids)))


def route_reliability_for(m, route_ids: DataFrame) -> DataFrame:
    """Same, for the routes listed in a DataFrame (semi join, no collect)."""
    return _reliability(m.scheduled_vs_actual.join(route_ids.distinct(), "route_id", "left_semi"))


def _reliability(s: DataFrame) -> DataFrame:
    d = F.col("delay_seconds")
    return s.groupBy("route_id").agg(
        rha(safe_divide(F.count_if(d <= 120), F.count(F.lit(1))) * 100, 1).alias("on_time_pct"),
        minutes(F.avg(d)).alias("avg_delay_minutes"),
        rha(safe_divide(F.count_if(d > 300), F.count(F.lit(1))) * 100, 1).alias("delay_risk_pct"))


def normalize_query(text_col, compat: bool = False):
    """Lower-case, non [a-z0-9 ] → space, trimmed. ``compat`` applies the
    regex before lower-casing (which drops capital letters)."""
    t = F.trim(text_col)
    if compat:
        return F.lower(F.regexp_replace(t, "[^a-z0-9 ]", " "))
    return F.regexp_replace(F.lower(t), "[^a-z0-9 ]", " ")


def route_text_by_stop(m) -> DataFrame:
    """Per stop: sorted distinct route descriptions (joined) and route count.

    Schedules are first reduced to distinct (stop, route) pairs with a
    partial aggregate; the per-stop list is bounded by the route count.
    """
    pairs = m.raw.schedules.select("stop_id", "route_id").distinct()
    r = F.broadcast(m.raw.routes.select(
        "route_id",
        F.lower(F.concat_ws(" ", F.coalesce("route_id", F.lit("")), F.coalesce("short_name", F.lit("")),
                            F.coalesce("long_name", F.lit("")), F.coalesce("description", F.lit(""))))
        .alias("rt")))
    return (pairs.join(r, "route_id")
            .groupBy("stop_id")
            .agg(F.array_join(F.array_sort(F.collect_set("rt")), " ").alias("route_text"),
                 F.countDistinct("route_id").alias("routes_served")))


def stop_texts(m) -> DataFrame:
    """Public stops with the texts that a search reads (``stop_text``, ``route_text``)."""
    st = m.raw.stops.filter(F.col("name").isNotNull() & F.col("latitude").isNotNull()
                            & F.col("longitude").isNotNull()
                            & ~F.col("stop_id").startswith("node-") & ~F.col("stop_id").startswith("door-"))
    st = st.select("stop_id", F.col("name").alias("stop_name"), "municipality", "latitude",
                   "longitude", "location_type",
                   search_location_desc("location_type").alias("location_type_desc"),
                   F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")),
                                       F.coalesce("municipality", F.lit("")),
                                       F.coalesce("stop_id", F.lit("")))).alias("stop_text"))
    return st.join(route_text_by_stop(m), "stop_id", "left").withColumns(
        {"route_text": F.coalesce("route_text", F.lit("")), "routes_served": F.coalesce("routes_served", F.lit(0))})


def query_tokens(q) -> F.Column:
    """Distinct words of at least three characters of a normalised query."""
    return F.array_distinct(F.filter(F.split(q, " "), lambda t: F.length(t) >= 3))


def match_score(q, tokens) -> F.Column:
    """Points of a row of ``stop_texts``; a NULL phrase ``q`` earns none."""
    stxt, rtxt, lt = F.col("stop_text"), F.col("route_text"), F.col("location_type")
    n_stop = F.size(F.filter(tokens, lambda t: stxt.contains(t)))
    n_route = F.size(F.filter(tokens, lambda t: rtxt.contains(t)))
    return (F.when(stxt == q, 120).when(stxt.contains(q), 90).otherwise(0)
            + n_stop * 12 + n_route * 8
            + F.when(rtxt.contains(q), 70).otherwise(0)
            + F.when(lt == 1, 10).when(lt == 0, 8).otherwise(0))


def match_order() -> list[F.Column]:
    """Best match first: points, routes served, stations before stops, name, id."""
    lt = F.col("location_type")
    return [F.col("match_score").desc(), F.col("routes_served").desc(),
            F.when(lt == 1, 0).when(lt == 0, 1).otherwise(2),
            F.col("stop_name").asc_nulls_first(), F.col("stop_id").asc()]


def search_stops(m, query: str, limit: int = 15, compat: bool = False) -> DataFrame:
    """Score every public stop against a free-text query.

    score = (120 exact | 90 phrase in stop text) + 12·tokens in stop text
    + 8·tokens in route text + 70 if the phrase is in the route text
    + (10 station | 8 stop); tokens are distinct words of ≥3 characters.
    Token matching uses higher-order functions per row — no join against a
    token table.
    """
    q = normalize_query(F.lit(query), compat)
    stxt, rtxt = F.col("stop_text"), F.col("route_text")
    source = (F.when(stxt.contains(q), F.lit("stop_name"))
              .when(rtxt.contains(q), F.lit("route_name")).otherwise(F.lit("token_match")))
    s = stop_texts(m).select("stop_id", "stop_name", "municipality", "latitude", "longitude", "location_type",
                             "location_type_desc", "routes_served",
                             match_score(q, query_tokens(q)).alias("match_score"), source.alias("match_source"))
    return top(s.filter(F.col("match_score") > 0), limit, *match_order())


def stop_routes(m, stop_id: str) -> DataFrame:
    s = m.raw.schedules.filter(F.col("stop_id") == stop_id).select("route_id", "direction_id")
    r = F.broadcast(m.raw.routes.select("route_id", F.col("long_name").alias("route_name"),
                                        "route_type", "route_type_desc", route_color().alias("route_color")))
    return (s.join(r, "route_id")
            .select("route_id", "route_name", "route_type", "route_type_desc", "route_color",
                    "direction_id").distinct())
