import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stopflow.operators import propagation
from stopflow.operators.propagation import khop
from stopflow.operators.snapshots import (
    EDGE_ATTRIBUTES,
    FEATURES,
    NODE,
    SNAPSHOT,
    assemble,
    dynamic_nodes,
    graph_stats,
    nonzero_snapshots,
    snapshot_class_mean,
    snapshot_edges,
    snapshot_size_check,
    static_nodes,
    with_edges,
)
from stopflow.sources import snapshot_store
from stopflow.sources.snapshot_store import read_snapshots, write_snapshots

DAY = date(2024, 1, 1)


def visit(stop, target, load=0.0, slot=1, minute=0, km=1.0, value=2.0):
    row = {
        "transit_date": DAY,
        "route_id": 3,
        "trip_id": 1,
        "route_direction_name": "FROM DOWNTOWN",
        "block_abbr": 1,
        "pattern_num": 1,
        "stop_sequence": minute,
        "departure_time": datetime(2024, 1, 1, 8, minute),
        "direction": 0,
        "slot": slot,
        "stop_id": stop,
        "source": stop,
        "target": target,
        "load": load,
        "vehicle_capacity": 40.0,
        **{c: value for c in FEATURES},
        **{c: km for c in EDGE_ATTRIBUTES},
    }
    return row


VISIT_SCHEMA = (
    "transit_date date, route_id int, trip_id int, route_direction_name string, block_abbr int, "
    "pattern_num int, stop_sequence int, departure_time timestamp_ntz, direction int, slot int, "
    "stop_id int, source int, target int, load double, vehicle_capacity double, "
    + ", ".join(f"{c} double" for c in (*FEATURES, *EDGE_ATTRIBUTES))
)


@pytest.fixture
def visits(spark):
    rows = [
        visit(1, 2, load=14.0, minute=1, km=1.0),
        visit(1, 2, load=3.0, minute=20, km=2.0, value=4.0),
        visit(2, 1, load=50.0, minute=5, km=2.0),
        visit(2, 9, load=0.0, minute=30, km=7.0),
        visit(5, None, minute=40),
        visit(3, None, slot=2, minute=50, load=0.0),
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], VISIT_SCHEMA)


def test_latest_duplicate_edge_wins(visits):
    edges = snapshot_edges(visits)
    got = {(r["source"], r["target"]): r["displacement"] for r in edges.collect()}
    assert got == {(1, 2): 2.0, (2, 1): 2.0, (2, 9): 7.0}


def test_dynamic_nodes_impute_zeros(visits):
    got = {(r["slot"], r["stop_id"]): r for r in dynamic_nodes(visits).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 9), (1, 5), (2, 3)}
    assert got[(1, 1)]["temperature"] == 3.0 and got[(1, 1)]["y"] == 1
    assert got[(1, 2)]["y"] == 3
    assert [got[(1, 9)][c] for c in FEATURES] == [0.0] * 10 and got[(1, 9)]["y"] == 0


@pytest.mark.parametrize("limits", ["default", "small"])
def test_static_nodes_impute_ones(request, visits, limits):
    if limits == "small":
        request.getfixturevalue("small_limits")
    nodes = static_nodes(visits)
    got = {(r["slot"], r["stop_id"]): r for r in nodes.collect()}
    assert set(got) == {(w, s) for w in (1, 2) for s in (1, 2, 3, 5)}
    assert [got[(2, 1)][c] for c in FEATURES] == [1.0] * 10 and got[(2, 1)]["y"] == 4
    assert got[(2, 3)]["y"] == 0
    assert snapshot_size_check(nodes, 4).count() == 0


def test_edgeless_and_zero_snapshots(visits):
    nodes, edges = dynamic_nodes(visits), snapshot_edges(visits)
    assert {r["slot"] for r in with_edges(nodes, edges).collect()} == {1}
    assert {r["slot"] for r in nonzero_snapshots(nodes).collect()} == {1}


def test_graph_stats(visits):
    nodes, edges = dynamic_nodes(visits), snapshot_edges(visits)
    got = {r["slot"]: r.asDict() for r in graph_stats(nodes, edges).collect()}
    assert got[1]["n_nodes"] == 4 and got[1]["n_edges"] == 3
    assert got[1]["has_isolated_nodes"] and not got[1]["has_self_loops"]
    assert not got[1]["is_undirected"]
    assert got[2]["n_edges"] == 0 and got[2]["is_undirected"]
    pair = edges.where("target <> 9")
    assert graph_stats(nodes, pair).where("slot = 1").first()["is_undirected"]
    uneven = pair.withColumn("displacement", F.col("source") * 1.0)
    assert not graph_stats(nodes, uneven).where("slot = 1").first()["is_undirected"]
    assert graph_stats(nodes, uneven, attrs=()).where("slot = 1").first()["is_undirected"]


def test_assemble_in_blocks(visits):
    nodes, edges = dynamic_nodes(visits), snapshot_edges(visits)
    node_blocks, edge_blocks = assemble(nodes, edges)
    first = node_blocks.where("slot = 1").first()
    assert first["part"] == 0 and first["y"] == [1, 3, 0, 0]
    assert [len(x) for x in first["x"]] == [10] * 4
    lines = {r["slot"]: r for r in edge_blocks.collect()}
    assert [tuple(e) for e in lines[1]["edge_index"]] == [(0, 1), (1, 0), (1, 3)]
    assert lines[1]["edge_attr"] == [[2.0], [2.0], [7.0]]
    assert 2 not in lines
    node_parts, edge_parts = assemble(nodes, edges, part_rows=2)
    labels = node_parts.where("slot = 1").orderBy("part").collect()
    ends = edge_parts.where("slot = 1").orderBy("part").collect()
    assert [r["y"] for r in labels] == [[1, 3], [0, 0]]
    assert [len(r["edge_index"]) for r in ends] == [2, 1]


def chain(spark):
    snapshot = "transit_date date, direction int, slot int"
    nodes = spark.createDataFrame(
        [(DAY, 0, 1, 1, 1.0), (DAY, 0, 1, 2, 2.0)], f"{snapshot}, stop_id int, f double"
    )
    edges = spark.createDataFrame(
        [(DAY, 0, 1, 1, 2, 1.0), (DAY, 0, 1, 2, 1, 1.0)],
        f"{snapshot}, source int, target int, displacement double",
    )
    return nodes, edges


def test_khop(spark):
    nodes, edges = chain(spark)
    got = khop(nodes, edges, 5, ["f"]).orderBy("stop_id").collect()
    assert [[r[f"t{k}_f"] for r in got] for k in range(5)] == [
        [1.0, 2.0],
        [-2.0, -1.0],
        [1.0, 2.0],
        [-2.0, -1.0],
        [1.0, 2.0],
    ]
    loop = edges.unionByName(edges.where("source = 1").withColumn("target", F.lit(1)))
    assert khop(nodes, loop, 2, ["f"]).orderBy("stop_id").first()["t1_f"] == -2.0
    assert khop(nodes, edges, 1, ["f"]).columns == [*NODE, "t0_f"]


def test_class_mean_modes(spark):
    rows = [(DAY, 0, 1, i, *[v] * 10, y) for i, (v, y) in enumerate([(1.0, 0), (3.0, 0), (8.0, 1)])]
    schema = "transit_date date, direction int, slot int, stop_id int, "
    schema += ", ".join(f"{c} double" for c in FEATURES) + ", y int"
    nodes = spark.createDataFrame(rows, schema)

    def means(mode):
        return {r["y"]: r["delay"] for r in snapshot_class_mean(nodes, mode).collect()}

    assert means("reference") == {0: 4.0, 1: 4.0}
    assert means("per_class") == {0: 2.0, 1: 8.0}
    with pytest.raises(ValueError):
        snapshot_class_mean(nodes, "other")


def test_snapshots_round_trip(spark, visits, tmp_path):
    nodes, edges = dynamic_nodes(visits), snapshot_edges(visits)
    write_snapshots(nodes, edges, str(tmp_path / "graphs"))
    got_nodes, got_edges = read_snapshots(spark, str(tmp_path / "graphs"))
    assert got_nodes.count() == 5 and got_edges.count() == 3
    assert set(SNAPSHOT) <= set(got_nodes.columns)


def _store(spark, dates, value):
    rows = [(d, i, float(value)) for d in dates for i in range(4)]
    df = spark.createDataFrame(rows, "transit_date string, stop_id int, x double")
    return df.withColumn("transit_date", F.to_date("transit_date"))


def _found(spark, path, number=None):
    return [sorted({(str(r.transit_date), r.x) for r in t.collect()}) for t in read_snapshots(spark, path, number)]


def test_snapshot_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    a, b, c = "2024-01-01", "2024-01-02", "2024-01-03"
    with pytest.raises(FileNotFoundError):
        read_snapshots(spark, path)
    write_snapshots(_store(spark, [a, b], 1), _store(spark, [a, b], 1), path)
    assert _found(spark, path) == [[(a, 1.0), (b, 1.0)]] * 2
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    # One date is replaced, one is new; the other keeps its files.
    write_snapshots(_store(spark, [b, c], 2), _store(spark, [c], 2), path, mode="dates")
    assert _found(spark, path) == [[(a, 1.0), (b, 2.0), (c, 2.0)], [(a, 1.0), (c, 2.0)]]
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert _found(spark, path, 1) == [[(a, 1.0), (b, 1.0)]] * 2
    with pytest.raises(ValueError):
        write_snapshots(_store(spark, [a], 3), _store(spark, [a], 3), path, mode="append")

    # A failure between the two tables, and one right before the commit, leave the old pair.
    broken = _store(spark, [a], 4).withColumn("x", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        write_snapshots(_store(spark, [a, b, c], 4), broken, path)
    before = _found(spark, path)
    monkeypatch.setattr(snapshot_store._Files, "commit", lambda *_: (_ for _ in ()).throw(OSError("cut")))
    with pytest.raises(OSError):
        write_snapshots(_store(spark, [a], 5), _store(spark, [a], 5), path)
    monkeypatch.undo()
    assert _found(spark, path) == before == [[(a, 1.0), (b, 2.0), (c, 2.0)], [(a, 1.0), (c, 2.0)]]

    # A second writer that began from the same version cannot commit.
    old = snapshot_store.manifest(spark, path)
    write_snapshots(_store(spark, [a], 6), _store(spark, [a], 6), path)
    monkeypatch.setattr(snapshot_store, "manifest", lambda *_: old)
    with pytest.raises(RuntimeError):
        write_snapshots(_store(spark, [a], 7), _store(spark, [a], 7), path)
    monkeypatch.undo()
    assert _found(spark, path) == [[(a, 6.0)]] * 2
    gone = snapshot_store.prune_snapshots(spark, path)
    assert len(gone) > 6 and _found(spark, path) == [[(a, 6.0)]] * 2
    none = _store(spark, [a], 8).limit(0)
    write_snapshots(none, none, path)
    assert _found(spark, path) == [[], []] and read_snapshots(spark, path)[0].columns == none.columns


def test_undirected_needs_every_attribute_alike(visits):
    nodes, edges = dynamic_nodes(visits), snapshot_edges(visits).where("target <> 9")
    for attr in EDGE_ATTRIBUTES:
        uneven = edges.withColumn(attr, F.when(F.col("source") < F.col("target"), 1.0).otherwise(2.0))
        assert not graph_stats(nodes, uneven).where("slot = 1").first()["is_undirected"], attr
        missing = edges.withColumn(attr, F.lit(None).cast("double"))
        assert graph_stats(nodes, missing).where("slot = 1").first()["is_undirected"], attr


def _exchanges(df):
    """Exchanges of the plan after execution."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found = []

    def walk(node):
        if node.nodeName() in ("Exchange", "BroadcastExchange"):
            found.append(node.nodeName())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_a_round_of_propagation_exchanges_messages_only(spark):
    rng = random.Random(3)
    snaps = [(DAY, "a", s) for s in range(3)]
    nodes = [(*k, i, rng.random()) for k in snaps for i in range(40)]
    edges = [(*k, rng.randrange(40), rng.randrange(40), rng.random()) for k in snaps for _ in range(200)]
    keys = "transit_date date, {} , {}".format(*(f"{c} {t}" for c, t in zip(SNAPSHOT[1:], ("string", "int"))))
    n = spark.createDataFrame(nodes, f"{keys}, stop_id int, x double")
    e = spark.createDataFrame(edges, f"{keys}, source int, target int, displacement double")
    first = propagation.bucketed(n.select(*NODE, "x"), NODE, "terms")
    norm = propagation.bucketed(propagation.normalised_edges(e), propagation.SOURCE, "laplacian")
    second = propagation.next_term(norm, first, None, ["x"])
    assert _exchanges(second) == ["Exchange"]
    kept = propagation.bucketed(second, NODE, "terms", dealt=True)
    assert _exchanges(propagation.next_term(norm, kept, first, ["x"])) == ["Exchange"]
    whole = khop(n, e, 3, ["x"])
    assert _exchanges(whole) == [] and whole.count() == 120
    # The recurrence in plain terms.
    for key in snaps:
        own = [r for r in edges if r[:3] == key and r[3] != r[4]]
        deg = {}
        for r in own:
            deg[r[3]] = deg.get(r[3], 0) + r[5]
        x = {r[3]: r[4] for r in nodes if r[:3] == key}

        def spread(v):
            out = dict.fromkeys(x, 0.0)
            for r in own:
                if deg.get(r[3], 0) > 0 and deg.get(r[4], 0) > 0:
                    out[r[4]] -= r[5] / math.sqrt(deg[r[3]] * deg[r[4]]) * v[r[3]]
            return out

        t1 = spread(x)
        t2 = {i: 2 * v - x[i] for i, v in spread(t1).items()}
        for r in whole.where(F.col(SNAPSHOT[2]) == key[2]).collect():
            got = (r.t0_x, r.t1_x, r.t2_x)
            assert got == pytest.approx((x[r.stop_id], t1[r.stop_id], t2[r.stop_id]), abs=1e-9)
