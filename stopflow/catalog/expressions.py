"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import Tables, bin_sql
from stopflow.functions import (
    argmax_class,
    calendar_parts,
    county_of,
    daypart,
    delay_minutes,
    epoch_shift,
    fold_window,
    haversine_km,
    is_weekend,
    load_bin,
    map_values,
    period_label,
    safe_ratio,
    window_n_min,
)
from stopflow.functions.scalars import DIRECTION_CODES, KNOWN_CAPACITIES
from stopflow.operators.cleaning import drop_nulls, fill_constant, percent_to_fraction
from stopflow.operators.enrich import WEATHER_VALUES, join_weather, weather_hourly_mean
from stopflow.operators.periods import with_period

ORDER_PERIODS = (
    ("September 1995", "1995-09-13", "1996-04-10"),
    ("April 1996", "1996-04-11", "1997-10-02"),
    ("October 1997", "1997-10-03", "1998-04-02"),
    ("April 1998", "1998-04-03", "1999-10-01"),
    ("October 1999", "1999-10-02", "2000-04-01"),
)
# The first two months in which a customer ordered, as periods that overlap.
_CUSTOMER_PERIODS = """
    SELECT CAST(o_custkey AS VARCHAR) AS period, CAST(min(o_orderdate) AS DATE) AS start_date,
           least(CAST(max(o_orderdate) AS DATE), CAST(min(o_orderdate) AS DATE) + 60) AS end_date
    FROM orders GROUP BY o_custkey
"""


@query(
    "period_table",
    "",
    f"""SELECT o_orderkey, (
          SELECT arg_min(period, ROW(-epoch(start_date), epoch(end_date), period))
          FROM ({_CUSTOMER_PERIODS}) WHERE CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date
        ) AS period FROM orders""",
)
def _(t: Tables):
    """The same by a join, for a period of every customer."""
    orders = t.table("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    first, last = F.min("day"), F.max("day")
    periods = orders.groupBy(F.col("o_custkey").cast("string").alias("period")).agg(
        first.alias("start_date"), F.least(last, F.date_add(first, 60)).alias("end_date")
    )
    return with_period(orders.drop("o_custkey"), periods, "day").select("o_orderkey", "period")


_PERIOD_SQL = " ".join(
    f"WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}' THEN '{name}'"
    for name, lo, hi in ORDER_PERIODS
)


@query(
    "period_label", "", f"SELECT o_orderkey, CASE {_PERIOD_SQL} END AS period FROM orders"
)
def _(t: Tables):
    return t.table("orders").select(
        "o_orderkey", period_label("o_orderdate", ORDER_PERIODS).alias("period")
    )


@query(
    "filter_in",
    "visits",
    """SELECT visit_id, route_direction_name FROM visits
       WHERE route_direction_name IN ('TO DOWNTOWN', 'FROM DOWNTOWN')""",
)
def _(t: Tables):
    kept = t.visits.where(F.col("route_direction_name").isin(*DIRECTION_CODES))
    return kept.select("visit_id", "route_direction_name")


@query(
    "filter_eq",
    "traffic",
    """SELECT xd_id, average_speed, measurement_tstamp FROM traffic WHERE county = 'davidson'""",
)
def _(t: Tables):
    kept = t.traffic.where(F.col("county") == "davidson")
    return kept.select("xd_id", "average_speed", "measurement_tstamp")


@query(
    "filter_group_slice", "visits", "SELECT visit_id, route_id FROM visits WHERE route_id = 3"
)
def _(t: Tables):
    return t.visits.where(F.col("route_id") == 3).select("visit_id", "route_id")


@query(
    "project",
    "visits",
    """SELECT visit_id, route_id, stop_id, y_reg100 AS load, icon AS weather_category
       FROM visits""",
)
def _(t: Tables):
    renamed = t.visits.withColumnsRenamed({"y_reg100": "load", "icon": "weather_category"})
    return renamed.select("visit_id", "route_id", "stop_id", "load", "weather_category")


@query(
    "cast_int",
    "",
    "SELECT c_custkey, CAST(right(c_name, 9) AS INTEGER) AS id FROM customer",
)
def _(t: Tables):
    return t.table("customer").select(
        "c_custkey", F.right(F.col("c_name"), F.lit(9)).cast("int").alias("id")
    )


@query(
    "delay_minutes",
    "raw",
    """SELECT arrival_time, scheduled_time,
              CAST(trunc((epoch_us(arrival_time) - epoch_us(scheduled_time)) / 60000000)
                   AS INTEGER) AS delay
       FROM raw""",
)
def _(t: Tables):
    return t.raw.select(
        "arrival_time",
        "scheduled_time",
        delay_minutes("arrival_time", "scheduled_time").alias("delay"),
    )


@query(
    "calendar_parts",
    "",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
              CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
              CAST(minute(ts) AS INTEGER) AS minute FROM events""",
)
def _(t: Tables):
    parts = calendar_parts("ts")
    return t.table("events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "window_5min",
    "",
    """SELECT event_id, CAST(round_even(minute(ts) / 5 + hour(ts) * 12, 0) AS INTEGER)
              AS time_window_5_mins FROM events""",
)
def _(t: Tables):
    slot = window_n_min(F.hour("ts"), F.minute("ts"))
    return t.table("events").select("event_id", slot.alias("time_window_5_mins"))


@query(
    "window_1hr",
    "visits",
    """SELECT visit_id, time_window // 2 AS hour_window,
              CASE WHEN time_window // 2 = 12 THEN 0 ELSE time_window // 2 END AS hour_window_12
       FROM visits""",
)
def _(t: Tables):
    return t.visits.select(
        "visit_id",
        fold_window("time_window", 2).alias("hour_window"),
        fold_window("time_window", 2, 12).alias("hour_window_12"),
    )


@query(
    "window_2hr",
    "visits",
    """SELECT visit_id, CASE WHEN (time_window + 1) // 4 = 12 THEN 0
                             ELSE (time_window + 1) // 4 END AS two_hour_window
       FROM visits""",
)
def _(t: Tables):
    # The upper end of the half hour, so that index 48 occurs.
    upper = F.col("time_window") + 1
    return t.visits.select("visit_id", fold_window(upper, 4).alias("two_hour_window"))


@query(
    "daypart",
    "visits",
    """SELECT visit_id, CASE WHEN time_window BETWEEN 8 AND 12 THEN 1
              WHEN time_window BETWEEN 13 AND 18 THEN 2 WHEN time_window BETWEEN 19 AND 28 THEN 3
              WHEN time_window BETWEEN 29 AND 36 THEN 4 ELSE 5 END AS new_time_window
       FROM visits""",
)
def _(t: Tables):
    return t.visits.select("visit_id", daypart("time_window").alias("new_time_window"))


@query(
    "is_weekend",
    "visits",
    "SELECT visit_id, dayofweek NOT BETWEEN 2 AND 6 AS is_weekend FROM visits",
)
def _(t: Tables):
    return t.visits.select("visit_id", is_weekend("dayofweek").alias("is_weekend"))


@query(
    "load_bin_fixed",
    "visits",
    f"""SELECT visit_id, CASE WHEN vehicle_capacity IN (15, 40, 45, 55)
               THEN {bin_sql("y_reg100", "vehicle_capacity")} ELSE 3 END AS load_bin_transit
        FROM visits""",
)
def _(t: Tables):
    bins = load_bin("y_reg100", "vehicle_capacity", KNOWN_CAPACITIES)
    return t.visits.select("visit_id", bins.alias("load_bin_transit"))


@query(
    "load_bin_any",
    "",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
               {bin_sql("(l_quantity - 2)", "CAST(20 + l_suppkey % 41 AS DOUBLE)")} AS load_bin
        FROM lineitem""",
)
def _(t: Tables):
    cap = (20 + F.col("l_suppkey") % 41).cast("double")
    bins = load_bin(F.col("l_quantity") - 2, cap)
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", bins.alias("load_bin")
    )


_HAVERSINE_SQL = """
    2 * 6371.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - ({a})))
"""
_A = (
    "pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
    " * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half_chord = _A.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)
    return _HAVERSINE_SQL.format(a=half_chord).strip()


@query(
    "haversine_km",
    "located",
    f"""SELECT visit_id, round({haversine_sql("36.1::DOUBLE", "-86.8::DOUBLE",
        "map_latitude", "map_longitude")}, 6) AS km FROM located""",
)
def _(t: Tables):
    km = haversine_km(F.lit(36.1), F.lit(-86.8), "map_latitude", "map_longitude")
    return rounded(t.located.select("visit_id", km.alias("km")))


@query(
    "parse_county",
    "blocks",
    """SELECT GEOID, split_part(trim(split_part(NAME, ',', 2)), ' ', 1) AS county_name
       FROM blocks""",
)
def _(t: Tables):
    return t.blocks.select("GEOID", county_of("NAME").alias("county_name"))


@query(
    "safe_ratio",
    "blocks",
    """SELECT GEOID, round(coalesce(no_public_transport_for_work
              / nullif(total_surveyed_public_transportation_for_work, 0), 0), 6) AS ratio
       FROM blocks""",
)
def _(t: Tables):
    ratio = safe_ratio(
        "no_public_transport_for_work", "total_surveyed_public_transportation_for_work"
    )
    return rounded(t.blocks.select("GEOID", ratio.alias("ratio")))


@query(
    "percent_to_fraction",
    "blocks",
    """SELECT GEOID, white_pct / 100 AS white_pct, black_pct / 100 AS black_pct,
              hispanic_pct / 100 AS hispanic_pct, public_transit_pct / 100 AS public_transit_pct
       FROM blocks""",
)
def _(t: Tables):
    out = percent_to_fraction(t.blocks)
    return out.select("GEOID", "white_pct", "black_pct", "hispanic_pct", "public_transit_pct")


@query(
    "fill_constant",
    "raw",
    """SELECT trip_id, arrival_time, coalesce(actual_hdwy, 0) AS actual_hdwy FROM raw""",
)
def _(t: Tables):
    filled = fill_constant(t.raw, {"actual_hdwy": 0})
    return filled.select("trip_id", "arrival_time", "actual_hdwy")


@query(
    "drop_nulls",
    "visits hourly",
    f"""SELECT visit_id, {r("precipitation_intensity", "temperature", "humidity")}
        FROM visits JOIN hourly USING (year, month, day, hour)""",
)
def _(t: Tables):
    joined = join_weather(t.visits, weather_hourly_mean(t.weather))
    kept = drop_nulls(joined, WEATHER_VALUES)
    return rounded(kept.select("visit_id", *WEATHER_VALUES))


@query(
    "map_values",
    "visits",
    """SELECT visit_id, CASE route_direction_name WHEN 'TO DOWNTOWN' THEN 1
              WHEN 'FROM DOWNTOWN' THEN 0 END AS direction,
              CASE WHEN is_holiday THEN 1 ELSE 0 END AS holiday FROM visits""",
)
def _(t: Tables):
    return t.visits.select(
        "visit_id",
        map_values("route_direction_name", DIRECTION_CODES).alias("direction"),
        map_values("is_holiday", {True: 1, False: 0}).alias("holiday"),
    )


@query(
    "epoch_shift",
    "weather",
    """SELECT time, TIMESTAMP '1970-01-01' + to_seconds(time - 18000) AS datetime
       FROM weather""",
)
def _(t: Tables):
    return t.weather.select("time", epoch_shift("time").alias("datetime"))


@query(
    "argmax_class",
    "scored",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
              CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS ypred
       FROM scored""",
)
def _(t: Tables):
    return t.scored.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_shipdate",
        argmax_class("scores").alias("ypred"),
    )
