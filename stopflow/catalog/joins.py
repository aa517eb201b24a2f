"""Equi, semi, anti and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import SNAP_SQL, TRIP_SQL, Tables, bin_sql
from stopflow.functions import load_bin
from stopflow.functions.scalars import KNOWN_CAPACITIES
from stopflow.operators.cleaning import null_rows
from stopflow.operators.enrich import (
    TRAFFIC_VALUES,
    WEATHER_VALUES,
    enrich,
    join_traffic,
    join_weather,
    traffic_slots,
    weather_hourly_mean,
    with_slot,
)
from stopflow.operators.snapshots import (
    NODE,
    SNAPSHOT,
    edge_lines,
    nonzero_snapshots,
    static_nodes,
)
from stopflow.operators.spatial import nearest_line, within
from stopflow.operators.stats import flag_small_groups, join_day_stats, stop_positions
from stopflow.operators.trips import (
    drop_self_loop_trips,
    drop_trips_any,
    drop_trips_without_capacity,
    keep_loaded_trips,
)
from stopflow.plans.enrichment import TRACT_VALUES
from stopflow.sources.readers import tract_profile

RADIUS = 0.005

_RAW_KEYS = (
    "route_id",
    "transit_date",
    "route_direction_name",
    "trip_id",
    "block_abbr",
    "pattern_num",
    "stop_sequence",
)


@query(
    "join_raw_enrich",
    "visits raw",
    f"""SELECT v.visit_id, {r("r.map_latitude", "r.map_longitude", "r.sched_hdwy",
        "r.actual_hdwy")},
        CAST(trunc((epoch_us(r.arrival_time) - epoch_us(r.scheduled_time)) / 60000000)
             AS INTEGER) AS delay
        FROM visits v LEFT JOIN raw r ON {" AND ".join(
            f"v.{k} IS NOT DISTINCT FROM r.{k}" for k in _RAW_KEYS)}""",
)
def _(t: Tables):
    cols = ["map_latitude", "map_longitude", "sched_hdwy", "actual_hdwy", "delay"]
    return rounded(enrich(t.visits, t.raw).select("visit_id", *cols))


TRAFFIC_JOIN_SQL = """
    SELECT v.*, s.xd_id, s.average_speed, s.reference_speed, s.congestion, s.extreme_congestion
    FROM located v LEFT JOIN slots s ON v.year = s.year AND v.month = s.month AND v.day = s.day
     AND CAST(round_even(minute(v.departure_time) / 5 + v.hour * 12, 0) AS INTEGER)
         = s.time_window_5_mins AND v.XDSegID = s.xd_id
"""


def traffic_joined(t: Tables):
    return join_traffic(with_slot(t.located), traffic_slots(t.traffic))


@query(
    "join_traffic",
    "located slots",
    f"""SELECT visit_id, xd_id, {r(*TRAFFIC_VALUES)} FROM ({TRAFFIC_JOIN_SQL})""",
)
def _(t: Tables):
    return rounded(traffic_joined(t).select("visit_id", "xd_id", *TRAFFIC_VALUES))


@query(
    "null_congestion",
    "located slots",
    f"""SELECT visit_id, {r("average_speed", "reference_speed", "extreme_congestion")}
        FROM ({TRAFFIC_JOIN_SQL}) WHERE congestion IS NULL""",
)
def _(t: Tables):
    """The second half of the null audit: visits that found no congestion value."""
    missing = null_rows(traffic_joined(t), "congestion")
    cols = ("average_speed", "reference_speed", "extreme_congestion")
    return rounded(missing.select("visit_id", *cols))


@query(
    "join_weather",
    "visits hourly",
    f"""SELECT visit_id, {r(*WEATHER_VALUES)}
        FROM visits LEFT JOIN hourly USING (year, month, day, hour)""",
)
def _(t: Tables):
    joined = join_weather(t.visits, weather_hourly_mean(t.weather))
    return rounded(joined.select("visit_id", *WEATHER_VALUES))


IN_TRACT_SQL = """
    map_longitude >= xmin AND map_longitude < xmax AND map_latitude >= ymin
    AND map_latitude < ymax
"""


@query(
    "join_point_in_polygon",
    "located profile",
    f"""SELECT visit_id, GEOID, {r(*TRACT_VALUES)} FROM located JOIN profile
        ON {IN_TRACT_SQL}""",
)
def _(t: Tables):
    joined = within(t.located, tract_profile(t.tracts), ["GEOID", *TRACT_VALUES])
    return rounded(joined.select("visit_id", "GEOID", *TRACT_VALUES))


def nearest_sql(source: str, radius: float, lines: str = "segments") -> str:
    """Nearest straight segment per distinct coordinate pair of a source."""
    return f"""
    SELECT map_longitude, map_latitude, arg_min(XDSegID, rank_key) AS XDSegID
    FROM (
      SELECT *, row_number() OVER (
               PARTITION BY map_longitude, map_latitude ORDER BY away, XDSegID) AS rank_key
      FROM (
        SELECT map_longitude, map_latitude, XDSegID,
               sqrt((map_longitude - (ax + u * dx)) * (map_longitude - (ax + u * dx))
                  + (map_latitude - (ay + u * dy)) * (map_latitude - (ay + u * dy))) AS away
        FROM (
          SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
                   ((map_longitude - ax) * dx + (map_latitude - ay) * dy)
                   / (dx * dx + dy * dy))) AS u
          FROM (SELECT DISTINCT map_longitude, map_latitude FROM {source}
                WHERE map_longitude IS NOT NULL AND map_latitude IS NOT NULL) p
          CROSS JOIN (SELECT XDSegID, StartLong AS ax, StartLat AS ay, EndLong - StartLong AS dx,
                             EndLat - StartLat AS dy FROM {lines}) s))
      WHERE away < {radius}::DOUBLE)
    WHERE rank_key = 1 GROUP BY map_longitude, map_latitude
    """


@query(
    "join_near_line",
    "located segments",
    f"""SELECT visit_id, n.XDSegID FROM located v LEFT JOIN ({nearest_sql("located", RADIUS)}) n
        ON v.map_longitude = n.map_longitude AND v.map_latitude = n.map_latitude""",
)
def _(t: Tables):
    joined = nearest_line(t.located.drop("XDSegID"), t.segments, RADIUS)
    return joined.select("visit_id", "XDSegID")


_BINNED_SQL = f"""
    (SELECT *, CASE WHEN vehicle_capacity IN (15, 40, 45, 55)
               THEN {bin_sql("y_reg100", "vehicle_capacity")} ELSE 3 END AS load_bin_transit
     FROM visits)
"""


@query(
    "semi_trip_has_load",
    "visits",
    f"""SELECT visit_id, load_bin_transit FROM {_BINNED_SQL}
        WHERE ({TRIP_SQL}) IN (SELECT ({TRIP_SQL}) FROM {_BINNED_SQL}
                               WHERE load_bin_transit > 0)""",
)
def _(t: Tables):
    bins = load_bin("y_reg100", "vehicle_capacity", KNOWN_CAPACITIES)
    kept = keep_loaded_trips(t.visits.withColumn("load_bin_transit", bins))
    return kept.select("visit_id", "load_bin_transit")


_RECURRING_SQL = "stop_id, hour"
_RECURRING = ["stop_id", "hour"]


@query(
    "anti_trip_flagged",
    "visits",
    f"""SELECT visit_id FROM visits WHERE ({TRIP_SQL}) NOT IN (
          SELECT ({TRIP_SQL}) FROM (
            SELECT *, count(*) OVER (PARTITION BY {_RECURRING_SQL}) AS n FROM visits)
          WHERE n < 2)""",
)
def _(t: Tables):
    flagged = flag_small_groups(t.visits, _RECURRING, 2)
    return drop_trips_any(flagged, F.col("remove_trip_condn")).select("visit_id")


@query(
    "anti_trip_null_capacity",
    "visits",
    f"""SELECT visit_id FROM visits WHERE ({TRIP_SQL}) NOT IN (
          SELECT ({TRIP_SQL}) FROM visits WHERE vehicle_capacity IS NULL)""",
)
def _(t: Tables):
    return drop_trips_without_capacity(t.visits).select("visit_id")


@query(
    "anti_trip_self_loop",
    "ready",
    f"""SELECT visit_id, source, target FROM ready WHERE ({TRIP_SQL}) NOT IN (
          SELECT ({TRIP_SQL}) FROM ready WHERE source = target)""",
)
def _(t: Tables):
    return drop_self_loop_trips(t.ready).select("visit_id", "source", "target")


@query(
    "semi_snapshot_nonzero",
    "nodes",
    f"""SELECT {SNAP_SQL}, stop_id, y FROM nodes WHERE ({SNAP_SQL}) IN (
          SELECT ({SNAP_SQL}) FROM nodes GROUP BY {SNAP_SQL} HAVING max(y) > 0)""",
)
def _(t: Tables):
    return nonzero_snapshots(t.nodes).select(*NODE, "y")


STATIC_SQL = """
    SELECT {feature_list} FROM (SELECT DISTINCT transit_date, direction, slot FROM outbound) g
    CROSS JOIN (SELECT DISTINCT source AS stop_id FROM outbound) l
    LEFT JOIN own_nodes o ON o.transit_date = g.transit_date AND o.direction = g.direction
         AND o.slot = g.slot AND o.stop_id = l.stop_id
"""


@query(
    "join_node_skeleton",
    "own_nodes",
    STATIC_SQL.format(
        feature_list="g.transit_date, g.direction, g.slot, l.stop_id, "
        "round(CASE WHEN o.stop_id IS NULL THEN 1 ELSE o.average_speed END, 6) AS average_speed"
    ),
)
def _(t: Tables):
    return rounded(static_nodes(t.outbound).select(*NODE, "average_speed"))


_POSITION_SQL = """
    SELECT stop_id,
           arg_min(map_longitude, departure_time) FILTER (map_longitude IS NOT NULL)
             AS map_longitude,
           arg_min(map_latitude, departure_time) FILTER (map_latitude IS NOT NULL)
             AS map_latitude
    FROM outbound GROUP BY stop_id
"""


@query(
    "join_edge_positions",
    "edges",
    f"""SELECT {", ".join("e." + c for c in SNAPSHOT)}, e.source, e.target,
               round(a.map_longitude, 6) AS x0, round(a.map_latitude, 6) AS y0,
               round(b.map_longitude, 6) AS x1, round(b.map_latitude, 6) AS y1
        FROM edges e JOIN ({_POSITION_SQL}) a ON a.stop_id = e.source
                     JOIN ({_POSITION_SQL}) b ON b.stop_id = e.target""",
)
def _(t: Tables):
    places = stop_positions(t.outbound, ["departure_time", "visit_id"])
    lines = edge_lines(t.edges, places)
    return rounded(lines.select(*SNAPSHOT, "source", "target", "x0", "y0", "x1", "y1"))


@query(
    "join_day_stats",
    "visits",
    """SELECT transit_date, count(DISTINCT route_id) AS n_routes,
              count(DISTINCT time_window) AS n_windows FROM visits GROUP BY transit_date""",
)
def _(t: Tables):
    return join_day_stats(t.visits, "time_window")
