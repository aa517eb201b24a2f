"""From prepared visits to snapshot graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.functions import fold_window, map_values
from stopflow.functions.scalars import BOOLEAN_CODES, DIRECTION_CODES
from stopflow.operators.cleaning import dedupe_first, fill_constant, percent_to_fraction
from stopflow.operators.scaling import apply_minmax, fit_minmax, label_encode
from stopflow.operators.skew import BLOCK, tag_blocks
from stopflow.operators.snapshots import (
    EDGE_ATTRIBUTES,
    OUTBOUND,
    SNAPSHOT,
    dynamic_nodes,
    snapshot_edges,
    static_nodes,
    with_edges,
)
from stopflow.operators.trips import (
    TRIP,
    TRIP_ORDER,
    drop_self_loop_trips,
    drop_trips_without_capacity,
    edge_target,
)
from stopflow.session import stored

# Half hours per snapshot window.
ONE_HOUR, TWO_HOURS = 2, 4
CODED = ("dayofweek", "month", "year", "slot")


def graph_ready(
    prepared: DataFrame,
    per: int = TWO_HOURS,
    fold: int | None = None,
    bounds: DataFrame | None = None,
    repair_routes: Sequence[int] | None = None,
    tie_break: Sequence[str] = ("departure_time",),
) -> DataFrame:
    """Scaled, coded visits with their edge target.

    Scaling bounds are fitted before gaps are filled with 0, so a filled value may lie outside
    [0, 1]. ``repair_routes`` lists the routes whose trips with self-loops are dropped. The
    first of several rows of a trip and stop sequence is kept, in ``tie_break`` order.
    """
    bounds = fit_minmax(prepared) if bounds is None else bounds
    windowed = prepared.withColumn("slot", fold_window("time_window", per, fold))
    rows = dedupe_first(windowed, [*TRIP, "stop_sequence"], tie_break)
    rows = fill_constant(rows, {"delay": 0, "actual_hdwy": 0})
    rows = rows.withColumns(
        {
            "direction": map_values("route_direction_name", DIRECTION_CODES),
            "is_holiday": map_values("is_holiday", BOOLEAN_CODES),
            "is_weekend": map_values("is_weekend", BOOLEAN_CODES),
        }
    ).where(F.col("direction").isNotNull())
    rows = apply_minmax(percent_to_fraction(rows), bounds)
    rows = tag_blocks(rows, TRIP, TRIP_ORDER)
    rows = drop_trips_without_capacity(rows, tagged=True)
    rows = edge_target(rows, "slot", tagged=True)
    if repair_routes is not None:
        rows = drop_self_loop_trips(rows, repair_routes, tagged=True)
    return label_encode(stored(rows.drop(BLOCK), "targets"), CODED)


def outbound(ready: DataFrame) -> DataFrame:
    """Visits of the direction the graphs are built for, with a complete snapshot key."""
    keyed: Column = F.col("direction") == OUTBOUND
    for c in SNAPSHOT:
        keyed = keyed & F.col(c).isNotNull()
    return ready.where(keyed)


def dynamic_snapshots(
    ready: DataFrame, attrs: Sequence[str] = EDGE_ATTRIBUTES
) -> tuple[DataFrame, DataFrame]:
    """Nodes seen in each snapshot, and edges; snapshots without edges are left out."""
    rows = outbound(ready)
    edges = snapshot_edges(rows, attrs)
    return with_edges(dynamic_nodes(rows), edges), edges


def static_snapshots(
    ready: DataFrame, attrs: Sequence[str] = EDGE_ATTRIBUTES
) -> tuple[DataFrame, DataFrame]:
    """Every stop in every snapshot, and edges; snapshots without edges are left out."""
    rows = outbound(ready)
    edges = snapshot_edges(rows, attrs)
    return with_edges(static_nodes(rows), edges), edges
