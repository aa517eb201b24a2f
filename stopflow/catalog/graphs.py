"""Snapshot graphs, neighbour features and baseline models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopflow.catalog.joins import STATIC_SQL
from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import FEATURE_NAMES, SNAP_SQL, Tables, bin_sql
from stopflow.operators import baselines
from stopflow.operators.propagation import khop
from stopflow.operators.scaling import minmax
from stopflow.operators.snapshots import (
    EDGE,
    EDGE_ATTRIBUTES,
    FEATURES,
    NODE,
    PART_ROWS,
    SNAPSHOT,
    assemble,
    drop_sentinel,
    edge_weight,
    graph_stats,
    snapshot_class_mean,
    static_nodes,
    with_edges,
)
from stopflow.operators.splits import stratified_fold
from stopflow.session import stored


@query(
    "snapshot_edges",
    "edges",
    f"SELECT {SNAP_SQL}, source, target, {r(*EDGE_ATTRIBUTES)} FROM edges",
)
def _(t: Tables):
    return rounded(t.edges)


@query(
    "drop_sentinel",
    "outbound",
    """SELECT visit_id, source, target FROM outbound WHERE target IS NOT NULL""",
)
def _(t: Tables):
    return drop_sentinel(t.outbound).select("visit_id", "source", "target")


@query(
    "snapshot_nodes_dynamic",
    "nodes",
    f"""SELECT {SNAP_SQL}, stop_id, {r(*FEATURE_NAMES[:6])},
        {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_NAMES[6:])}, y FROM nodes""",
)
def _(t: Tables):
    return rounded(t.nodes)


_STATIC_COLUMNS = ", ".join(
    f"round(CAST(CASE WHEN o.stop_id IS NULL THEN 1 ELSE o.{c} END AS DOUBLE), 6) AS {c}"
    for c in FEATURE_NAMES
)


@query(
    "snapshot_nodes_static",
    "own_nodes",
    STATIC_SQL.format(
        feature_list=f"g.transit_date, g.direction, g.slot, l.stop_id, {_STATIC_COLUMNS}, "
        f"CASE WHEN o.stop_id IS NULL THEN 4 ELSE "
        f"{bin_sql('o.top_load', 'o.top_capacity')} END AS y"
    ),
)
def _(t: Tables):
    return rounded(static_nodes(t.outbound))


@query(
    "drop_edgeless_snapshots",
    "nodes edges",
    f"""SELECT {SNAP_SQL}, stop_id, y FROM nodes
        WHERE ({SNAP_SQL}) IN (SELECT ({SNAP_SQL}) FROM edges)""",
)
def _(t: Tables):
    return with_edges(t.nodes, t.edges).select(*NODE, "y")


@query(
    "graph_stats",
    "nodes edges",
    f"""
    SELECT {SNAP_SQL}, n_nodes, coalesce(n_edges, 0) AS n_edges,
           round(coalesce(n_edges, 0) / n_nodes, 6) AS average_degree,
           isolated > 0 AS has_isolated_nodes, coalesce(loops, 0) > 0 AS has_self_loops,
           coalesce(one_way, 0) = 0 AS is_undirected
    FROM (SELECT n.transit_date, n.direction, n.slot, count(*) AS n_nodes,
                 count(*) FILTER (t.stop_id IS NULL) AS isolated
          FROM nodes n LEFT JOIN (
            SELECT {SNAP_SQL}, source AS stop_id FROM edges WHERE source <> target
            UNION SELECT {SNAP_SQL}, target FROM edges WHERE source <> target) t
          ON t.transit_date = n.transit_date AND t.direction = n.direction AND t.slot = n.slot
             AND t.stop_id = n.stop_id
          GROUP BY 1, 2, 3)
    LEFT JOIN (
      SELECT e.transit_date, e.direction, e.slot, count(*) AS n_edges,
             count(*) FILTER (e.source = e.target) AS loops,
             count(*) FILTER (b.source IS NULL) AS one_way
      FROM edges e LEFT JOIN edges b
      ON b.transit_date = e.transit_date AND b.direction = e.direction AND b.slot = e.slot
         AND b.source = e.target AND b.target = e.source
         AND {" AND ".join(f"b.{c} IS NOT DISTINCT FROM e.{c}" for c in EDGE_ATTRIBUTES)}
      GROUP BY 1, 2, 3) USING ({SNAP_SQL})
    """,
)
def _(t: Tables):
    return rounded(graph_stats(t.nodes, t.edges))


_INDEX_SQL = f"""
    , placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY {SNAP_SQL} ORDER BY stop_id) - 1
                             AS INTEGER) AS idx FROM nodes)
"""


def _place(part: str = "part") -> Column:
    """Position in the snapshot of an exploded block entry."""
    return (F.col(part) * PART_ROWS + F.col("_at")).cast("int")


@query(
    "assemble_snapshots",
    "nodes",
    f"""{_INDEX_SQL}
    SELECT {SNAP_SQL}, idx, y,
           {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FEATURE_NAMES)}
    FROM placed""",
)
def _(t: Tables):
    blocks, _ = assemble(t.nodes, t.edges, EDGE_ATTRIBUTES)
    rows = blocks.select(
        *SNAPSHOT, "part", F.posexplode(F.arrays_zip("x", "y")).alias("_at", "_row")
    )
    values = [F.get(F.col("_row.x"), i).alias(c) for i, c in enumerate(FEATURES)]
    return rounded(rows.select(*SNAPSHOT, _place().alias("idx"), F.col("_row.y").alias("y"), *values))


@query(
    "assemble_snapshot_edges",
    "nodes edges",
    f"""{_INDEX_SQL}
    SELECT {SNAP_SQL}, CAST(row_number() OVER (PARTITION BY {SNAP_SQL}
               ORDER BY source_idx, target_idx) - 1 AS INTEGER) AS nth,
           source_idx, target_idx, {r(*EDGE_ATTRIBUTES)}
    FROM (SELECT e.*, s.idx AS source_idx, g.idx AS target_idx FROM edges e
          JOIN placed s ON s.transit_date = e.transit_date AND s.direction = e.direction
            AND s.slot = e.slot AND s.stop_id = e.source
          JOIN placed g ON g.transit_date = e.transit_date AND g.direction = e.direction
            AND g.slot = e.slot AND g.stop_id = e.target)""",
)
def _(t: Tables):
    _, blocks = assemble(t.nodes, t.edges, EDGE_ATTRIBUTES)
    rows = blocks.select(
        *SNAPSHOT,
        "part",
        F.posexplode(F.arrays_zip("edge_index", "edge_attr")).alias("_at", "_row"),
    )
    values = [F.get(F.col("_row.edge_attr"), i).alias(c) for i, c in enumerate(EDGE_ATTRIBUTES)]
    ends = [F.col(f"_row.edge_index.{c}").alias(c) for c in ("source_idx", "target_idx")]
    return rounded(rows.select(*SNAPSHOT, _place().alias("nth"), *ends, *values))


@query(
    "assembled_shapes",
    "nodes edges",
    f"""SELECT {SNAP_SQL}, 10 AS n_features, n_nodes, sum_y, coalesce(n_edges, 0) AS n_edges
        FROM (SELECT {SNAP_SQL}, count(*) AS n_nodes, CAST(sum(y) AS BIGINT) AS sum_y
              FROM nodes GROUP BY {SNAP_SQL})
        LEFT JOIN (SELECT {SNAP_SQL}, count(*) AS n_edges FROM edges GROUP BY {SNAP_SQL})
        USING ({SNAP_SQL})""",
)
def _(t: Tables):
    node_blocks, edge_blocks = assemble(t.nodes, t.edges)
    labels = F.aggregate("y", F.lit(0), lambda a, y: a + y)
    shapes = node_blocks.groupBy(*SNAPSHOT).agg(
        F.max(F.size(F.get(F.col("x"), 0))).alias("n_features"),
        F.sum(F.size("x")).alias("n_nodes"),
        F.sum(labels).alias("sum_y"),
    )
    counts = edge_blocks.groupBy(*SNAPSHOT).agg(F.sum(F.size("edge_index")).alias("n_edges"))
    return shapes.join(counts, list(SNAPSHOT), "left").fillna({"n_edges": 0})


@query(
    "edge_weight_first_attr",
    "edges",
    f"SELECT {SNAP_SQL}, source, target, {r('displacement')} FROM edges".replace(
        "AS displacement", "AS weight"
    ),
)
def _(t: Tables):
    return rounded(edge_weight(t.edges).select(*EDGE, "weight"))


def _khop_sql() -> str:
    """Three Chebyshev terms of all features, the recurrence written out."""

    def each(template: str) -> str:
        return ", ".join(template.format(c=c) for c in FEATURE_NAMES)

    def step(name: str, terms: str, term: str) -> str:
        return f"""{name} AS (
            SELECT {SNAP_SQL}, target AS stop_id, {each("sum(w * " + term + ") AS m_{c}")}
            FROM norm JOIN (SELECT * RENAME (stop_id AS source) FROM {terms})
            USING ({SNAP_SQL}, source) GROUP BY {SNAP_SQL}, target)"""

    return f"""
    , plain AS (SELECT {SNAP_SQL}, source, target, displacement AS w FROM edges
                WHERE source <> target),
    degree AS (SELECT {SNAP_SQL}, source, sum(w) AS d FROM plain GROUP BY {SNAP_SQL}, source),
    norm AS (SELECT p.transit_date, p.direction, p.slot, p.source, p.target,
                    CASE WHEN a.d > 0 AND b.d > 0 THEN -p.w / sqrt(a.d * b.d) ELSE 0 END AS w
             FROM plain p
             LEFT JOIN degree a ON a.transit_date = p.transit_date AND a.direction = p.direction
                  AND a.slot = p.slot AND a.source = p.source
             LEFT JOIN degree b ON b.transit_date = p.transit_date AND b.direction = p.direction
                  AND b.slot = p.slot AND b.source = p.target),
    t0 AS (SELECT {SNAP_SQL}, stop_id, {each("CAST({c} AS DOUBLE) AS t0_{c}")} FROM nodes),
    {step("m1", "t0", "t0_{c}")},
    t1 AS (SELECT t0.*, {each("coalesce(m_{c}, 0) AS t1_{c}")}
           FROM t0 LEFT JOIN m1 USING ({SNAP_SQL}, stop_id)),
    {step("m2", "t1", "t1_{c}")}
    SELECT {SNAP_SQL}, stop_id, {each("round(t0_{c}, 6) AS t0_{c}")},
           {each("round(t1_{c}, 6) AS t1_{c}")},
           {each("round(2 * coalesce(m_{c}, 0) - t0_{c}, 6) AS t2_{c}")}
    FROM t1 LEFT JOIN m2 USING ({SNAP_SQL}, stop_id)
    """


@query("khop_features", "nodes edges", _khop_sql())
def _(t: Tables):
    return rounded(khop(t.nodes, t.edges, 3))


# Predictions follow from training and have no SQL; tests/test_baselines.py compares the learners
# with plain versions and their accuracy with the majority class, and the folds have SQL above.


def _split_examples(t: Tables, scale: bool = False):
    """First of five stratified folds as test, as for the published baselines."""
    rows = stored(snapshot_class_mean(t.nodes).select(*SNAPSHOT, "y", *FEATURES), "examples")
    if scale:
        rows = minmax(rows, FEATURES)
    folds = stratified_fold(rows, "y", [*SNAPSHOT, "y"])
    return folds.where("not is_test"), folds.where("is_test")


def _forest(t: Tables):
    train, test = _split_examples(t)
    return baselines.batch_score(baselines.train(baselines.random_forest(), train), test, *SNAPSHOT)


@query("ml_random_forest", "nodes")
def _(t: Tables):
    return _forest(t)


@query("ml_mlp", "nodes")
def _(t: Tables):
    train, test = _split_examples(t, scale=True)
    return baselines.batch_score(baselines.train_perceptron(train), test, *SNAPSHOT)


@query("ml_boosted_trees", "nodes")
def _(t: Tables):
    train, test = _split_examples(t)
    return baselines.batch_score(baselines.train_boosted_trees(train), test, *SNAPSHOT)


@query("ml_batch_score", "nodes")
def _(t: Tables):
    """How often each class was predicted for each true one."""
    return _forest(t).groupBy("ytrue", "ypred").agg(F.count("*").alias("rows"))
