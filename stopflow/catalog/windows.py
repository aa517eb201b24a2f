"""Ordered work along a trip, splits, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.aggregates import SNAP_KEYS_SQL
from stopflow.catalog.expressions import haversine_sql
from stopflow.catalog.joins import TRAFFIC_JOIN_SQL, traffic_joined
from stopflow.catalog.registry import query, rounded
from stopflow.catalog.roles import ORDER_SQL, SNAP_SQL, TRIP_SQL, Tables
from stopflow.operators.enrich import TRAFFIC_VALUES
from stopflow.operators.snapshots import SNAPSHOT
from stopflow.operators.splits import best_epoch, exact_split, ordered_split, stratified_fold
from stopflow.operators.stats import top_days
from stopflow.operators.trips import (
    TRIP,
    TRIP_ORDER,
    cut_target_at_window_end,
    displacement,
    fill_traffic,
    fill_traffic_backward,
    fill_traffic_forward,
    lead_target,
    snapshot_end_rows,
)

KEY_TEXT_SQL = f"concat_ws('|', {SNAP_KEYS_SQL}, '42')"
_TRIP_WINDOW = f"(PARTITION BY {TRIP_SQL} ORDER BY {ORDER_SQL}"


@query(
    "lead_displacement",
    "located",
    f"""SELECT visit_id, round(coalesce({haversine_sql(
        "map_latitude", "map_longitude", "nlat", "nlon")}, 0), 6) AS displacement
        FROM (SELECT *, lead(map_latitude) OVER w AS nlat, lead(map_longitude) OVER w AS nlon
              FROM located WINDOW w AS {_TRIP_WINDOW}))""",
)
def _(t: Tables):
    return rounded(displacement(t.located).select("visit_id", "displacement"))


def _filled(fwd: bool, bwd: bool) -> str:
    cols = []
    for c in ("xd_id", *TRAFFIC_VALUES):
        parts = []
        if fwd:
            parts.append(
                f"last_value({c} IGNORE NULLS) OVER {_TRIP_WINDOW} "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            )
        if bwd:
            parts.append(
                f"first_value({c} IGNORE NULLS) OVER {_TRIP_WINDOW} "
                "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
            )
        value = f"coalesce({', '.join(parts)})"
        cols.append(f"{value} AS {c}" if c == "xd_id" else f"round({value}, 6) AS {c}")
    return f"SELECT visit_id, {', '.join(cols)} FROM ({TRAFFIC_JOIN_SQL})"


def _fills(df):
    return rounded(df.select("visit_id", "xd_id", *TRAFFIC_VALUES))


@query("fill_forward", "located slots", _filled(True, False))
def _(t: Tables):
    return _fills(fill_traffic_forward(traffic_joined(t)))


@query("fill_backward", "located slots", _filled(False, True))
def _(t: Tables):
    return _fills(fill_traffic_backward(traffic_joined(t)))


@query("fill_both", "located slots", _filled(True, True))
def _(t: Tables):
    return _fills(fill_traffic(traffic_joined(t)))


@query(
    "lead_target",
    "prepared",
    f"""SELECT visit_id, stop_id AS source, lead(stop_id) OVER {_TRIP_WINDOW}) AS target
        FROM prepared""",
)
def _(t: Tables):
    return lead_target(t.prepared).select("visit_id", "source", "target")


@query(
    "cut_target_at_window_end", "ready", "SELECT visit_id, slot, source, target FROM ready"
)
def _(t: Tables):
    cut = cut_target_at_window_end(lead_target(t.prepared), "slot")
    return cut.select("visit_id", "slot", "source", "target")


@query(
    "cut_target_at_snapshot_end",
    "ready",
    f"""SELECT route_id, {SNAP_SQL}, source, target IS NOT NULL AS open FROM (
          SELECT *, row_number() OVER (PARTITION BY route_id, {SNAP_SQL}
                    ORDER BY {", ".join(c + " DESC" for c in (*TRIP, *TRIP_ORDER))}) AS nth
          FROM ready) WHERE nth = 1""",
)
def _(t: Tables):
    return snapshot_end_rows(t.ready, SNAPSHOT)


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
_LINE_ORDER_SQL = ", ".join(_LINE_ORDER)


@query(
    "stratified_fold",
    "",
    f"""SELECT {_LINE_ORDER_SQL}, y, nth <= ceil(total / 5) - ceil((total - size) / 5)
               AS is_test
        FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_LINE_ORDER_SQL}) AS nth
              FROM (SELECT *, l_linenumber % 4 AS y FROM lineitem))
        JOIN (SELECT y, size, sum(size) OVER (ORDER BY seen) AS total
              FROM (SELECT l_linenumber % 4 AS y, count(*) AS size,
                           min(ROW({_LINE_ORDER_SQL})) AS seen
                    FROM lineitem GROUP BY 1)) USING (y)""",
)
def _(t: Tables):
    lines = t.table("lineitem").select(*_LINE_ORDER, (F.col("l_linenumber") % 4).alias("y"))
    return stratified_fold(lines, "y", _LINE_ORDER)


@query(
    "ordered_split",
    "outbound",
    f"""SELECT {SNAP_SQL}, CASE WHEN pos < train THEN 'train'
               WHEN pos < train + val THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT *, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT)
                          - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS train,
                     CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS val
              FROM (SELECT *, row_number() OVER (ORDER BY {SNAP_SQL}) - 1 AS pos,
                           count(*) OVER () AS n
                    FROM (SELECT DISTINCT {SNAP_SQL} FROM outbound)))
        WHERE pos <> train AND pos <> train + val""",
)
def _(t: Tables):
    return ordered_split(t.outbound.select(*SNAPSHOT).distinct(), SNAPSHOT)


@query(
    "ordered_split_plain",
    "outbound",
    f"""SELECT {SNAP_SQL}, CASE WHEN pos < n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'train'
               ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY {SNAP_SQL}) - 1 AS pos, count(*) OVER () AS n
              FROM (SELECT DISTINCT {SNAP_SQL} FROM outbound))""",
)
def _(t: Tables):
    """First four fifths and last fifth by position, with no validation part and no gap."""
    snapshots = t.outbound.select(*SNAPSHOT).distinct()
    return ordered_split(snapshots, SNAPSHOT, validation=0.0, seam_gap=0)


@query(
    "random_split",
    "outbound",
    f"""SELECT {SNAP_SQL}, CASE WHEN place <= n_test THEN 'test'
               WHEN place <= n_test + ceil((n - n_test) * 0.12::DOUBLE) THEN 'validation'
               ELSE 'train' END AS split
        FROM (SELECT *, count(*) OVER () AS n, ceil(count(*) OVER () * 0.2::DOUBLE) AS n_test,
                     row_number() OVER (ORDER BY md5({KEY_TEXT_SQL})) AS place
              FROM (SELECT DISTINCT {SNAP_SQL} FROM outbound))""",
)
def _(t: Tables):
    return exact_split(t.outbound.select(*SNAPSHOT).distinct(), SNAPSHOT)


@query(
    "best_epoch",
    "history",
    """SELECT run, epoch, validation_loss FROM (
         SELECT *, row_number() OVER (PARTITION BY run ORDER BY validation_loss, epoch DESC)
                   AS nth FROM history) WHERE nth = 1""",
)
def _(t: Tables):
    return best_epoch(t.history, per=["run"])


@query(
    "best_epoch_overall",
    "history",
    "SELECT run, epoch, validation_loss FROM history ORDER BY validation_loss, epoch DESC LIMIT 1",
)
def _(t: Tables):
    return best_epoch(t.history)


@query(
    "sort_visits",
    "visits",
    f"SELECT visit_id, {TRIP_SQL}, {ORDER_SQL} FROM visits ORDER BY {TRIP_SQL}, {ORDER_SQL}",
)
def _(t: Tables):
    keys = [*TRIP, *TRIP_ORDER]
    return t.visits.select("visit_id", *keys).orderBy(*keys)


@query(
    "sort_in_group_desc",
    "visits",
    f"""SELECT visit_id, {TRIP_SQL}, {ORDER_SQL} FROM visits
        ORDER BY {TRIP_SQL}, stop_sequence DESC, departure_time DESC""",
)
def _(t: Tables):
    rows = t.visits.select("visit_id", *TRIP, *TRIP_ORDER)
    return rows.orderBy(*TRIP, *[F.desc(c) for c in TRIP_ORDER])


@query(
    "top_days",
    "visits",
    """SELECT day AS transit_date, n_routes, n_windows FROM (
         SELECT CAST(departure_time AS DATE) AS day, count(DISTINCT route_id) AS n_routes,
                count(DISTINCT time_window) AS n_windows FROM visits GROUP BY 1)
       ORDER BY n_routes DESC, n_windows DESC, day LIMIT 10""",
)
def _(t: Tables):
    daily = t.visits.withColumn("transit_date", F.to_date("departure_time"))
    return top_days(daily, "time_window")


@query(
    "union_all",
    "visits raw",
    f"""SELECT {TRIP_SQL}, stop_sequence, departure_time AS event_time FROM visits
        UNION ALL SELECT {TRIP_SQL}, stop_sequence, arrival_time FROM raw""",
)
def _(t: Tables):
    a = t.visits.select(*TRIP, "stop_sequence", F.col("departure_time").alias("event_time"))
    b = t.raw.select(*TRIP, "stop_sequence", F.col("arrival_time").alias("event_time"))
    return a.unionByName(b)
