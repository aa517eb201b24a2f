"""Snapshot graphs: one directed stop graph per (date, direction, time window).

A graph is two keyed tables, nodes and edges, instead of an object per snapshot. Both are far
smaller than the visits and hold each key once. Joins between them are plain: where one snapshot or
stop outweighs the rest, adaptive execution splits its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.functions import load_bin
from stopflow.operators.ordered import rank_in_group
from stopflow.operators.skew import adaptive_join, keyed_join
from stopflow.operators.trips import TRIP, TRIP_ORDER
from stopflow.session import stored

SNAPSHOT = ("transit_date", "direction", "slot")
NODE = (*SNAPSHOT, "stop_id")
EDGE = (*SNAPSHOT, "source", "target")

# Node features in matrix order, edge attributes, label of an absent stop.
NUMERIC_FEATURES = (
    "precipitation_intensity",
    "temperature",
    "humidity",
    "delay",
    "average_speed",
    "extreme_congestion",
)
CODE_FEATURES = ("dayofweek_cat", "month_cat", "year_cat", "slot_cat")
FEATURES = NUMERIC_FEATURES + CODE_FEATURES
EDGE_ATTRIBUTES = (
    "displacement",
    "median_income_last12months",
    "white_pct",
    "black_pct",
    "hispanic_pct",
    "public_transit_pct",
    "pct_public_transit_for_work",
)
NO_BUS = 4
OUTBOUND = 0

# Nodes or edges of one block of an assembled snapshot.
PART_ROWS = 4096
# Stops of a list that is joined as one row.
STOP_LIST = 1_000


def _feature_aggs() -> list[Column]:
    # Codes are constant within a snapshot, so the minimum is the first value.
    return [F.avg(c).alias(c) for c in NUMERIC_FEATURES] + [
        F.min(c).alias(c) for c in CODE_FEATURES
    ]


def _label() -> Column:
    return load_bin(F.max("load"), F.max("vehicle_capacity"))


def node_features(visits: DataFrame) -> DataFrame:
    """Ten features per (snapshot, stop): means of six measures, four calendar codes."""
    return visits.groupBy(*NODE).agg(*_feature_aggs())


def node_labels(visits: DataFrame) -> DataFrame:
    """Occupancy bin per (snapshot, stop): highest load against highest capacity."""
    return visits.groupBy(*NODE).agg(_label().alias("y"))


def snapshot_edges(
    visits: DataFrame,
    attrs: Sequence[str] = EDGE_ATTRIBUTES,
    order: Sequence[str] = ("departure_time", *TRIP, *TRIP_ORDER[:1]),
) -> DataFrame:
    """Distinct edges per snapshot with the attributes of the latest visit."""
    latest = F.max_by(F.struct(*attrs), F.struct(*order))
    edges = drop_sentinel(visits).groupBy(*EDGE).agg(latest.alias("_attrs"))
    return edges.select(*EDGE, "_attrs.*")


def drop_sentinel(visits: DataFrame) -> DataFrame:
    """Rows with a real next stop; a trip or window end makes no edge."""
    return visits.where(F.col("target").isNotNull())


def dynamic_nodes(visits: DataFrame) -> DataFrame:
    """Stops seen in each snapshot as either end of an edge, with features and labels.

    A stop that is only a target gets zeros and label 0. Each visit is expanded into its two
    ends, so nodes, features and labels come out of a single aggregation.
    """
    measures = [*FEATURES, "load", "vehicle_capacity"]
    ends = F.when(
        F.col("target").isNotNull(),
        F.array(
            F.struct(F.col("source").alias("stop_id"), F.lit(True).alias("own")),
            F.struct(F.col("target").alias("stop_id"), F.lit(False).alias("own")),
        ),
    ).otherwise(
        F.array(F.struct(F.col("source").alias("stop_id"), F.lit(True).alias("own")))
    )
    rows = visits.select(*SNAPSHOT, *measures, F.explode(ends).alias("end"))
    own = F.col("end.own")
    rows = rows.select(
        *SNAPSHOT,
        F.col("end.stop_id").alias("stop_id"),
        own.alias("_own"),
        *[F.when(own, F.col(c)).alias(c) for c in measures],
    )
    nodes = rows.groupBy(*NODE).agg(
        F.max("_own").alias("_own"), *_feature_aggs(), _label().alias("y")
    )
    return _impute(nodes, 0.0, 0)


def _impute(nodes: DataFrame, feature: float, label: int) -> DataFrame:
    """Constant features and label where the stop had no visit of its own."""
    own = F.coalesce(F.col("_own"), F.lit(False))
    return nodes.select(
        *NODE,
        *[F.when(own, F.col(c)).otherwise(F.lit(feature)).alias(c) for c in FEATURES],
        F.when(own, F.col("y")).otherwise(F.lit(label)).alias("y"),
    )


def skeleton(snapshots: DataFrame, stops: DataFrame, part_stops: int = STOP_LIST) -> DataFrame:
    """Every snapshot with every stop of the fixed list.

    The result is the full grid by definition. Stops are gathered in lists of about
    ``part_stops``; what is joined are (snapshot, part) pairs with the lists, an equi-join on the
    part, and only its result is expanded to stops.
    """
    parts = max(-(-stops.count() // part_stops), 1)
    part = F.pmod(F.xxhash64("stop_id"), F.lit(parts)).cast("int")
    lists = stops.groupBy(part.alias("_part")).agg(F.collect_list("stop_id").alias("_stops"))
    spread = snapshots.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = adaptive_join(spread, lists, ["_part"], "inner")
    return pairs.select(*snapshots.columns, F.explode("_stops").alias("stop_id"))


def static_nodes(visits: DataFrame) -> DataFrame:
    """All stops of the visits in every snapshot; an unvisited stop has ones and label 4."""
    stops = stored(visits.select(F.col("source").alias("stop_id")).distinct(), "stops")
    grid = skeleton(visits.select(*SNAPSHOT).distinct(), stops)
    seen = visits.groupBy(*NODE).agg(
        *_feature_aggs(), _label().alias("y"), F.lit(True).alias("_own")
    )
    # Both sides hold each (snapshot, stop) once, so the join key is spread evenly.
    return _impute(grid.join(seen, list(NODE), "left"), 1.0, NO_BUS)


def with_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop the nodes of snapshots without any edge."""
    return nodes.join(edges.select(*SNAPSHOT).distinct(), list(SNAPSHOT), "left_semi")


def nonzero_snapshots(nodes: DataFrame) -> DataFrame:
    """Drop snapshots whose labels are all 0."""
    keep = nodes.groupBy(*SNAPSHOT).agg(F.max("y").alias("_top")).where("_top > 0")
    return nodes.join(keep.drop("_top"), list(SNAPSHOT), "left_semi")


def edge_weight(edges: DataFrame, attr: str = "displacement") -> DataFrame:
    """Edges with their first attribute as weight."""
    return edges.select(*EDGE, F.col(attr).alias("weight"))


def edge_lines(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges with longitude and latitude of both ends, the data behind a map."""
    out, positions = edges, stored(positions, "positions")
    for end, tag in (("source", "0"), ("target", "1")):
        place = positions.select(
            F.col("stop_id").alias(end),
            F.col("map_longitude").alias(f"x{tag}"),
            F.col("map_latitude").alias(f"y{tag}"),
        )
        out = keyed_join(out, place, [end], "inner")
    return out


def graph_stats(
    nodes: DataFrame, edges: DataFrame, attrs: Sequence[str] = EDGE_ATTRIBUTES
) -> DataFrame:
    """Size and shape of every snapshot.

    A node is isolated when no edge joins it to another node. A graph is undirected when every
    edge has its reverse with equal attributes. Both are counted per node and per unordered
    pair first, so the edge table is never joined to itself.
    """
    proper = edges.where(F.col("source") != F.col("target"))
    touched = proper.select(
        *SNAPSHOT, F.explode(F.array("source", "target")).alias("stop_id"), F.lit(1).alias("_d")
    )
    per_node = (
        nodes.select(*NODE, F.lit(0).alias("_d"))
        .unionByName(touched)
        .groupBy(*NODE)
        .agg(F.max("_d").alias("_d"))
        .groupBy(*SNAPSHOT)
        .agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.count_if(F.col("_d") == 0).alias("_isolated"),
        )
    )
    values = F.struct(*attrs) if attrs else F.lit(0)
    per_pair = (
        edges.groupBy(
            *SNAPSHOT,
            F.least("source", "target").alias("_a"),
            F.greatest("source", "target").alias("_b"),
        )
        .agg(
            F.count(F.lit(1)).alias("_n"),
            (F.min(values) == F.max(values)).alias("_equal"),
        )
        .groupBy(*SNAPSHOT)
        .agg(
            F.sum("_n").alias("n_edges"),
            F.count_if(F.col("_a") == F.col("_b")).alias("_loops"),
            F.count_if(
                (F.col("_a") != F.col("_b"))
                & ((F.col("_n") < 2) | ~F.coalesce("_equal", F.lit(False)))
            ).alias("_one_way"),
        )
    )
    both = per_node.join(per_pair, list(SNAPSHOT), "left")
    n_edges = F.coalesce("n_edges", F.lit(0)).cast("long")
    return both.select(
        *SNAPSHOT,
        "n_nodes",
        n_edges.alias("n_edges"),
        (n_edges / F.col("n_nodes")).alias("average_degree"),
        (F.col("_isolated") > 0).alias("has_isolated_nodes"),
        (F.coalesce("_loops", F.lit(0)) > 0).alias("has_self_loops"),
        (F.coalesce("_one_way", F.lit(0)) == 0).alias("is_undirected"),
    )


def snapshot_size_check(nodes: DataFrame, expected: int | Column) -> DataFrame:
    """Snapshots whose node count is not the expected one."""
    sizes = nodes.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n_nodes"))
    wanted = F.lit(expected) if isinstance(expected, int) else expected
    return sizes.where(F.col("n_nodes") != wanted)


def node_index(nodes: DataFrame) -> DataFrame:
    """0-based position of each stop in its snapshot, in stop order."""
    ranked = rank_in_group(nodes, SNAPSHOT, ["stop_id"], "idx")
    return ranked.withColumn("idx", (F.col("idx") - 1).cast("int"))


def assemble(
    nodes: DataFrame,
    edges: DataFrame,
    attrs: Sequence[str] = ("displacement",),
    part_rows: int = PART_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Matrices of every snapshot in two tables of blocks, keyed by (snapshot, ``part``).

    Node blocks hold ``x`` and ``y`` of the nodes ``part * part_rows`` and following, by node
    index; edge blocks hold ``edge_index`` pairs and ``edge_attr`` of as many edges in the order
    of their ends. Every snapshot has parts, whatever its size, so no array grows without bound.
    """
    indexed = stored(node_index(nodes), "indexed")
    vector = F.array(*[F.col(c).cast("double") for c in FEATURES])
    node_blocks = (
        indexed.groupBy(*SNAPSHOT, F.floor(F.col("idx") / part_rows).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("idx", vector.alias("x"), "y"))).alias("_n"))
        .select(*SNAPSHOT, "part", F.col("_n.x").alias("x"), F.col("_n.y").alias("y"))
    )
    placed = edges
    for end in ("source", "target"):
        ids = indexed.select(
            *SNAPSHOT, F.col("stop_id").alias(end), F.col("idx").alias(f"{end}_idx")
        )
        placed = placed.join(ids, [*SNAPSHOT, end])
    numbered = rank_in_group(placed, SNAPSHOT, ["source_idx", "target_idx"], "_nth")
    values = F.array(*[F.col(a).cast("double") for a in attrs])
    edge_blocks = (
        numbered.groupBy(*SNAPSHOT, F.floor((F.col("_nth") - 1) / part_rows).alias("part"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("source_idx", "target_idx", values.alias("attr")))
            ).alias("_e")
        )
        .select(
            *SNAPSHOT,
            "part",
            F.arrays_zip("_e.source_idx", "_e.target_idx").alias("edge_index"),
            F.col("_e.attr").alias("edge_attr"),
        )
    )
    return node_blocks, edge_blocks


def snapshot_class_mean(nodes: DataFrame, mode: str = "reference") -> DataFrame:
    """One feature row per (snapshot, class present).

    ``reference``: every class of a snapshot carries the mean over all its nodes.
    ``per_class``: the mean over the nodes of that class.
    """
    if mode == "per_class":
        return nodes.groupBy(*SNAPSHOT, "y").agg(*[F.avg(c).alias(c) for c in FEATURES])
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")
    # Sums per class first; what is combined across classes is a handful of rows.
    sums = nodes.groupBy(*SNAPSHOT, "y").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in FEATURES],
        *[F.count(c).alias(f"_n_{c}") for c in FEATURES],
    )
    whole = sums.groupBy(*SNAPSHOT).agg(
        F.collect_set("y").alias("_classes"),
        *[
            F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(c)
            for c in FEATURES
        ],
    )
    return whole.select(*SNAPSHOT, F.explode("_classes").alias("y"), *FEATURES)
