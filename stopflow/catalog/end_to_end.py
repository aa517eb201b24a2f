"""Whole plans: visit enrichment, graph building, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.aggregates import HISTOGRAM_SQL, prf_sql
from stopflow.catalog.expressions import haversine_sql
from stopflow.catalog.joins import IN_TRACT_SQL, nearest_sql
from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import ORDER_SQL, TRIP_SQL, Tables, bin_sql
from stopflow.functions import fold_window, map_values
from stopflow.functions.scalars import DIRECTION_CODES
from stopflow.operators.cleaning import PERCENT_COLUMNS, dedupe_first
from stopflow.operators.scaling import SCALED_COLUMNS
from stopflow.operators.snapshots import (
    CODE_FEATURES,
    EDGE_ATTRIBUTES,
    FEATURES,
    NUMERIC_FEATURES,
    node_labels,
)
from stopflow.operators.stats import class_histogram
from stopflow.operators.trips import TRIP
from stopflow.plans.enrichment import TRACT_VALUES, enriched_visits, prepared_visits
from stopflow.plans.evaluation import dynamic_report, static_report
from stopflow.plans.graphs import dynamic_snapshots, graph_ready, static_snapshots
from stopflow.sources.readers import tract_profile


def occupancy_histogram(t: Tables):
    """Which bin did each stop reach in each two-hour snapshot, and how often is each bin?"""
    rows = dedupe_first(t.visits, [*TRIP, "stop_sequence"], ["departure_time"])
    keyed = rows.withColumnsRenamed({"y_reg100": "load"}).withColumns(
        {
            "direction": map_values("route_direction_name", DIRECTION_CODES),
            "slot": fold_window("time_window", 4),
        }
    )
    return class_histogram(node_labels(keyed.where(F.col("direction").isNotNull())))


OCCUPANCY_SQL = f"""
    , nodes AS (
      SELECT {bin_sql("top_load", "top_capacity")} AS y FROM (
        SELECT max(y_reg100) AS top_load, max(vehicle_capacity) AS top_capacity
        FROM (SELECT *, row_number() OVER (PARTITION BY {TRIP_SQL}, stop_sequence
                        ORDER BY departure_time) AS nth FROM visits)
        WHERE nth = 1 AND route_direction_name <> 'CROSSTOWN'
        GROUP BY transit_date, route_direction_name, time_window // 4, stop_id))
    {HISTOGRAM_SQL}
"""
query("occupancy_histogram", "visits", OCCUPANCY_SQL)(occupancy_histogram)

ROAD_RADIUS = 0.001
_TRAFFIC = ("xd_id", "average_speed", "reference_speed", "congestion", "extreme_congestion")
_RAW_KEYS = (*TRIP, "stop_sequence")
_FULL_ORDER = f"{ORDER_SQL}, delay NULLS FIRST, sched_hdwy NULLS FIRST, actual_hdwy NULLS FIRST"


def _fill(c: str) -> str:
    part = f"OVER (PARTITION BY {TRIP_SQL}, year, month ORDER BY {_FULL_ORDER} ROWS BETWEEN"
    return (
        f"coalesce(last_value({c} IGNORE NULLS) {part} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) {part} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    )


ENRICHED_SQL = f"""
    , joined AS (
      SELECT DISTINCT v.*, map_latitude, map_longitude, sched_hdwy, actual_hdwy,
             CAST(trunc((epoch_us(arrival_time) - epoch_us(scheduled_time)) / 60000000)
                  AS INTEGER) AS delay
      FROM visits v LEFT JOIN raw r
        ON {" AND ".join(f"v.{k} = r.{k}" for k in _RAW_KEYS)}
      WHERE v.route_direction_name IN ('TO DOWNTOWN', 'FROM DOWNTOWN')),
    moved AS (
      SELECT * EXCLUDE (nlat, nlon), coalesce({haversine_sql(
          "map_latitude", "map_longitude", "nlat", "nlon")}, 0) AS displacement
      FROM (SELECT *, lead(map_latitude) OVER w AS nlat, lead(map_longitude) OVER w AS nlon
            FROM joined WINDOW w AS (PARTITION BY {TRIP_SQL} ORDER BY {_FULL_ORDER}))),
    placed AS (
      SELECT m.*, {", ".join("p." + c for c in TRACT_VALUES)}
      FROM moved m JOIN profile p ON {IN_TRACT_SQL}),
    lined AS (
      SELECT p.*, n.XDSegID FROM placed p LEFT JOIN ({nearest_sql("placed", ROAD_RADIUS, "roads")}) n
      ON p.map_longitude = n.map_longitude AND p.map_latitude = n.map_latitude),
    driven AS (
      SELECT l.*, {", ".join("s." + c for c in _TRAFFIC)}
      FROM lined l LEFT JOIN slots s ON l.year = s.year AND l.month = s.month
       AND l.day = s.day AND l.XDSegID = s.xd_id
       AND CAST(round_even(minute(l.departure_time) / 5 + l.hour * 12, 0) AS INTEGER)
           = s.time_window_5_mins),
    enriched AS (
      SELECT * EXCLUDE ({", ".join(_TRAFFIC)}), {", ".join(_fill(c) for c in _TRAFFIC)}
      FROM driven)
"""
_INPUTS = "visits raw profile roads slots"


def _enriched(t: Tables):
    return enriched_visits(
        t.visits, t.raw, tract_profile(t.tracts), t.roads, t.traffic, ROAD_RADIUS
    )


_ENRICHED_VALUES = (
    "displacement",
    *TRACT_VALUES,
    *_TRAFFIC[1:],
    "sched_hdwy",
    "actual_hdwy",
    "map_latitude",
    "map_longitude",
)


@query(
    "visit_enrichment",
    _INPUTS,
    f"""{ENRICHED_SQL}
    SELECT visit_id, XDSegID, xd_id, delay, {r(*_ENRICHED_VALUES)} FROM enriched""",
)
def _(t: Tables):
    cols = list(_ENRICHED_VALUES)
    return rounded(_enriched(t).select("visit_id", "XDSegID", "xd_id", "delay", *cols))


PREPARED_SQL = f"""{ENRICHED_SQL},
    binned AS (
      SELECT *, CASE WHEN vehicle_capacity IN (15, 40, 45, 55)
                THEN {bin_sql("y_reg100", "vehicle_capacity")} ELSE 3 END AS load_bin_transit
      FROM enriched),
    complete AS (
      SELECT b.*, precipitation_intensity, temperature, humidity
      FROM binned b JOIN hourly h ON b.year = h.year AND b.month = h.month AND b.day = h.day
       AND b.hour = h.hour
      WHERE ({TRIP_SQL}) IN (SELECT ({TRIP_SQL}) FROM binned WHERE load_bin_transit > 0)
        AND xd_id IS NOT NULL)
"""


def _prepared(t: Tables):
    return prepared_visits(_enriched(t), t.weather)


@query(
    "visit_preparation",
    f"{_INPUTS} hourly",
    f"""{PREPARED_SQL}
    SELECT visit_id, delay, load_bin_transit, xd_id,
           {r("displacement", "average_speed", "precipitation_intensity", "temperature",
              "humidity")} FROM complete""",
)
def _(t: Tables):
    cols = [
        "displacement",
        "average_speed",
        "precipitation_intensity",
        "temperature",
        "humidity",
    ]
    prepared = _prepared(t).select("visit_id", "delay", "load_bin_transit", "xd_id", *cols)
    return rounded(prepared)


TIES = ["departure_time", "delay", "sched_hdwy", "actual_hdwy"]


_GAPS = ("delay", "actual_hdwy")
_BOUNDS = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in SCALED_COLUMNS)
_SCALED = ", ".join(
    f"({f'coalesce({c}, 0)' if c in _GAPS else c} - {c}_lo)"
    f" / coalesce(nullif({c}_hi - {c}_lo, 0), 1) AS {c}"
    for c in SCALED_COLUMNS
)
_FRACTIONS = ", ".join(f"{c} / 100 AS {c}" for c in PERCENT_COLUMNS)
_CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_cat"
    for c in ("dayofweek", "month", "year", "slot")
)
_ATTRIBUTES = ", ".join(
    f"arg_max({c}, ROW(departure_time, {TRIP_SQL}, stop_sequence)) AS {c}"
    for c in EDGE_ATTRIBUTES
)


def _ready_sql(per: int) -> str:
    """Scaled visits of the outbound direction with their codes and edge target."""
    return f"""{PREPARED_SQL},
    bounds AS (SELECT {_BOUNDS} FROM complete),
    firsts AS (
      SELECT * EXCLUDE (nth) FROM (
        SELECT *, row_number() OVER (PARTITION BY {TRIP_SQL}, stop_sequence
                  ORDER BY departure_time, delay NULLS FIRST, sched_hdwy NULLS FIRST,
                           actual_hdwy NULLS FIRST) AS nth
        FROM complete) WHERE nth = 1),
    scaled AS (
      SELECT *, {_CODES} FROM (
        SELECT * REPLACE ({_SCALED}, {_FRACTIONS}), time_window // {per} AS slot, 0 AS direction
        FROM firsts CROSS JOIN bounds
        WHERE ({TRIP_SQL}) NOT IN (SELECT ({TRIP_SQL}) FROM firsts
                                   WHERE vehicle_capacity IS NULL))),
    outbound AS (
      SELECT * EXCLUDE (following, more), stop_id AS source,
             CASE WHEN more IS NOT NULL THEN following END AS target
      FROM (SELECT *, lead(stop_id) OVER (PARTITION BY {TRIP_SQL} ORDER BY {ORDER_SQL})
                        AS following,
                   lead(1) OVER (PARTITION BY {TRIP_SQL}, slot ORDER BY {ORDER_SQL}) AS more
            FROM scaled WHERE route_direction_name = 'FROM DOWNTOWN')),
    edges AS (
      SELECT transit_date, slot, source, target, {_ATTRIBUTES}
      FROM outbound WHERE target IS NOT NULL GROUP BY 1, 2, 3, 4),
    seen AS (
      SELECT transit_date, slot, stop_id, max(y_reg100) AS top_load,
             max(vehicle_capacity) AS top_capacity,
             {", ".join(f"avg({c}) AS {c}" for c in NUMERIC_FEATURES)},
             {", ".join(f"min({c}) AS {c}" for c in CODE_FEATURES)}
      FROM outbound GROUP BY 1, 2, 3)
    """


def _graph(t: Tables, per: int, build):
    ready = graph_ready(_prepared(t), per, tie_break=TIES)
    nodes, _ = build(ready)
    codes = [F.col(c).cast("double").alias(c) for c in CODE_FEATURES]
    keys = ("transit_date", "slot", "stop_id")
    return rounded(nodes.select(*keys, *NUMERIC_FEATURES, *codes, "y"))


def _imputed(value: int) -> str:
    return ", ".join(
        f"round(CAST(CASE WHEN s.stop_id IS NULL THEN {value} ELSE s.{c} END AS DOUBLE), 6) AS {c}"
        for c in FEATURES
    )


def _dynamic_sql(per: int) -> str:
    return f"""{_ready_sql(per)}
    SELECT e.transit_date, e.slot, e.stop_id,
           {_imputed(0)},
           CASE WHEN s.stop_id IS NULL THEN 0
                ELSE {bin_sql("s.top_load", "s.top_capacity")} END AS y
    FROM (SELECT transit_date, slot, source AS stop_id FROM outbound
          UNION SELECT transit_date, slot, target FROM outbound WHERE target IS NOT NULL) e
    LEFT JOIN seen s ON s.transit_date = e.transit_date AND s.slot = e.slot
     AND s.stop_id = e.stop_id
    WHERE (e.transit_date, e.slot) IN (SELECT (transit_date, slot) FROM edges)
    """


@query("graph_dynamic_1hr", f"{_INPUTS} hourly", _dynamic_sql(2))
def _(t: Tables):
    return _graph(t, 2, lambda ready: dynamic_snapshots(ready, ["displacement"]))


@query("graph_dynamic_2hr", f"{_INPUTS} hourly", _dynamic_sql(4))
def _(t: Tables):
    return _graph(t, 4, dynamic_snapshots)


@query(
    "graph_static_1hr",
    f"{_INPUTS} hourly",
    f"""{_ready_sql(2)}
    SELECT g.transit_date, g.slot, l.stop_id,
           {_imputed(1)},
           CASE WHEN s.stop_id IS NULL THEN 4
                ELSE {bin_sql("s.top_load", "s.top_capacity")} END AS y
    FROM (SELECT DISTINCT transit_date, slot FROM edges) g
    CROSS JOIN (SELECT DISTINCT source AS stop_id FROM outbound) l
    LEFT JOIN seen s ON s.transit_date = g.transit_date AND s.slot = g.slot
     AND s.stop_id = l.stop_id""",
)
def _(t: Tables):
    return _graph(t, 2, static_snapshots)


@query(
    "graph_edges_2hr",
    f"{_INPUTS} hourly",
    f"""{_ready_sql(4)}
    SELECT transit_date, slot, source, target, {r(*EDGE_ATTRIBUTES)} FROM edges""",
)
def _(t: Tables):
    _, edges = dynamic_snapshots(graph_ready(_prepared(t), 4, tie_break=TIES))
    cols = ["transit_date", "slot", "source", "target", *EDGE_ATTRIBUTES]
    return rounded(edges.select(*cols))


def _report_sql(rows: str, where: str, k: int, shift: str = "(ypred + 1) % 5") -> str:
    source = f"(SELECT ytrue, {shift} AS ypred FROM preds {where})"
    name = f"'{rows}' AS rows, " if rows else ""
    return f"""
    SELECT {name}accuracy, precision, recall, f1, ordinal_accuracy
    FROM ({prf_sql(source)}) CROSS JOIN (
      SELECT round(avg(CASE WHEN ytrue = ypred THEN 1 ELSE 0 END), 6) AS accuracy,
             round(avg(1 - abs(ytrue - ypred) / {k}), 6) AS ordinal_accuracy FROM {source})
    """


@query(
    "evaluation_report",
    "preds",
    f"{_report_sql('all', '', 5)} UNION ALL {_report_sql('served', 'WHERE ytrue <> 4', 5)}",
)
def _(t: Tables):
    return rounded(static_report(t.preds.withColumn("ypred", (F.col("ypred") + 1) % 5)))


@query("evaluation_report_dynamic", "preds", _report_sql("", "", 4, shift="ypred"))
def _(t: Tables):
    return rounded(dynamic_report(t.preds))
