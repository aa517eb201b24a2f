"""Trip-level operators: ordered work along a trip, and trips kept or dropped as a whole.

A trip with a missing key part has no identity; its rows take no part and are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.functions import haversine_km
from stopflow.operators.ordered import (
    any_in_group,
    fill_backward,
    fill_both,
    fill_forward,
    lead_in_group,
)
from stopflow.operators.skew import BLOCK, tag_blocks

# Trips are told apart within a route; with the route in the key all routes go in one frame.
TRIP = (
    "route_id",
    "transit_date",
    "trip_id",
    "route_direction_name",
    "block_abbr",
    "pattern_num",
)
TRIP_ORDER = ("stop_sequence", "departure_time")
TRAFFIC_COLUMNS = (
    "xd_id",
    "average_speed",
    "reference_speed",
    "congestion",
    "extreme_congestion",
)


def with_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def displacement(
    visits: DataFrame,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """Kilometres to the next stop of the trip; 0 at the last stop or without coordinates."""
    ahead = {"_next_lat": "map_latitude", "_next_lon": "map_longitude"}
    out = lead_in_group(with_key(visits, keys), keys, order, ahead, tagged)
    km = haversine_km("map_latitude", "map_longitude", "_next_lat", "_next_lon")
    out = out.withColumn("displacement", F.coalesce(km, F.lit(0.0)))
    return out.drop("_next_lat", "_next_lon", "has_next")


def fill_traffic_forward(
    visits, cols=TRAFFIC_COLUMNS, keys=TRIP, order=TRIP_ORDER, tagged=False
):
    return fill_forward(with_key(visits, keys), keys, order, cols, tagged)


def fill_traffic_backward(
    visits, cols=TRAFFIC_COLUMNS, keys=TRIP, order=TRIP_ORDER, tagged=False
):
    return fill_backward(with_key(visits, keys), keys, order, cols, tagged)


def fill_traffic(visits, cols=TRAFFIC_COLUMNS, keys=TRIP, order=TRIP_ORDER, tagged=False):
    """Forward fill, then backward fill, in one sort of the trip."""
    return fill_both(with_key(visits, keys), keys, order, cols, tagged)


def lead_target(
    visits: DataFrame,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """``source`` = this stop, ``target`` = the trip's next stop, NULL at its end."""
    named = with_key(visits, keys).withColumn("source", F.col("stop_id"))
    return lead_in_group(named, keys, order, {"target": "source"}, tagged).drop("has_next")


def cut_target_at_window_end(
    visits: DataFrame,
    window_col: str,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """NULL the target on the last row of each (trip, time window).

    Windows of one trip may interleave, so this is not a lead inside (trip, window): a target
    may well lie in another window, only the window's last row loses its edge. Rows without a
    window belong to no snapshot and are dropped.
    """
    rows = visits.where(F.col(window_col).isNotNull())
    group = [*keys, window_col]
    marked = lead_in_group(rows, group, order, {"_seen": "source"}, tagged)
    target = F.when(F.col("has_next"), F.col("target"))
    return marked.withColumn("target", target).drop("_seen", "has_next")


def edge_target(
    visits: DataFrame,
    window_col: str,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """Next stop as edge target, cut at the end of each (trip, window).

    Both steps share one exchange on the trip key.
    """
    source = visits if tagged else tag_blocks(visits, keys, order)
    led = lead_target(source, keys, order, tagged=True)
    cut = cut_target_at_window_end(led, window_col, keys, order, tagged=True)
    return cut if tagged else cut.drop(BLOCK)


def snapshot_end_rows(
    visits: DataFrame,
    snapshot: Sequence[str],
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    per: Sequence[str] = ("route_id",),
) -> DataFrame:
    """Last row of every (route, snapshot) and whether its target is still open.

    After ``edge_target`` no row is open: a snapshot's last row ends a (trip, window) too.
    """
    place = F.struct(*keys, *order)
    last = with_key(visits, snapshot).groupBy(*per, *snapshot).agg(
        F.max_by(F.struct("source", "target"), place).alias("_last")
    )
    return last.select(
        *per,
        *snapshot,
        F.col("_last.source").alias("source"),
        F.col("_last.target").isNotNull().alias("open"),
    )


def keep_trips_with(
    visits: DataFrame,
    hit: Column,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """Trips with at least one row where ``hit`` holds.

    The mark is set by a window over the trip, so it shares the exchange of the other trip
    operators instead of joining the visits to themselves.
    """
    marked = any_in_group(with_key(visits, keys), keys, order, hit, "_hit", tagged)
    return marked.where("_hit").drop("_hit")


def drop_trips_any(
    visits: DataFrame,
    flag: Column,
    keys: Sequence[str] = TRIP,
    order: Sequence[str] = TRIP_ORDER,
    tagged: bool = False,
) -> DataFrame:
    """Trips where no row is flagged."""
    marked = any_in_group(with_key(visits, keys), keys, order, flag, "_hit", tagged)
    return marked.where("NOT _hit").drop("_hit")


def keep_loaded_trips(
    visits: DataFrame, bin_col: str = "load_bin_transit", tagged: bool = False
) -> DataFrame:
    """Drop trips whose load bin is 0 on every stop."""
    return keep_trips_with(visits, F.col(bin_col) > 0, tagged=tagged)


def drop_trips_without_capacity(visits: DataFrame, tagged: bool = False) -> DataFrame:
    """Drop trips with any missing vehicle capacity."""
    return drop_trips_any(visits, F.col("vehicle_capacity").isNull(), tagged=tagged)


def drop_self_loop_trips(
    visits: DataFrame, routes: Sequence[int] | None = None, tagged: bool = False
) -> DataFrame:
    """Drop trips with any edge from a stop to itself, of all routes or just the given ones."""
    loop = F.col("source") == F.col("target")
    if routes is not None:
        loop = loop & F.col("route_id").isin(*routes)
    return drop_trips_any(visits, loop, tagged=tagged)
