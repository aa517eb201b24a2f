"""Lead, fill, rank and group flags: small goldens, then heavy groups against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stopflow.operators import ordered, trips
from stopflow.operators.skew import (
    BLOCK,
    fan_out_join,
    heavy_groups,
    keyed_join,
    tag_blocks,
)

KEYS = ["trip"]
ORDER = ["seq", "tie"]
SCHEMA = "trip int, seq int, tie int, stop int, w int, v int"


def make_rows(seed=3, hot=400):
    """One trip with most rows, several small ones, a NULL key, gaps in v."""
    rng = random.Random(seed)
    rows = []
    for trip, n in [(1, hot), (2, 3), (3, 1), (4, 30), (None, 45)]:
        for i in range(n):
            gap = rng.random() < 0.7 or (trip == 1 and 100 < i < 220)
            v = None if gap else rng.randrange(1000)
            rows.append((trip, i // 3, i, rng.randrange(50), rng.randrange(4), v))
    rng.shuffle(rows)
    return rows


def by_group(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def expected(rows, fn):
    out = {}
    for trip, group in by_group(rows).items():
        for r, value in zip(group, fn(group), strict=True):
            out[(trip, r[2])] = value
    return out


def actual(df, *cols):
    return {(r["trip"], r["tie"]): tuple(r[c] for c in cols) for r in df.collect()}


def forward(group):
    last, out = None, []
    for r in group:
        last = r[5] if r[5] is not None else last
        out.append((last,))
    return out


def backward(group):
    return forward(group[::-1])[::-1]


def both(group):
    return [(a[0] if a[0] is not None else b[0],) for a, b in zip(forward(group), backward(group))]


@pytest.fixture(params=["plain", "heavy"])
def mode(request, spark):
    if request.param == "heavy":
        request.getfixturevalue("small_limits")
    return request.param


@pytest.fixture
def rows():
    return make_rows()


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_heavy_groups_found(spark, df, mode):
    hot = heavy_groups(df, KEYS)
    if mode == "plain":
        assert hot is None
    else:
        assert {r["_hot_trip"] for r in hot.collect()} == {1, 4, None}


def test_blocks_are_consecutive_and_small(df, mode):
    tagged = tag_blocks(df, KEYS, ORDER)
    if mode == "plain":
        assert tagged.columns == df.columns
        return
    blocks = {}
    for r in tagged.collect():
        blocks.setdefault(r["trip"], {}).setdefault(r[BLOCK], []).append((r["seq"], r["tie"]))
    assert set(blocks[2]) == {None} and set(blocks[3]) == {None}
    assert len(blocks[1]) > 10
    assert max(len(b) for b in blocks[1].values()) < 60
    ordered_blocks = [sorted(blocks[1][b]) for b in sorted(blocks[1])]
    for a, b in zip(ordered_blocks, ordered_blocks[1:]):
        assert a[-1] < b[0]


def test_lead(df, rows, mode):
    out = ordered.lead_in_group(df, KEYS, ORDER, {"after": "v", "next_stop": "stop"})
    assert BLOCK not in out.columns

    def lead(group):
        following = [*group[1:], None]
        return [(n[5], n[3], True) if n else (None, None, False) for n in following]

    assert actual(out, "after", "next_stop", "has_next") == expected(rows, lead)


@pytest.mark.parametrize(
    "name, fn", [("fill_forward", forward), ("fill_backward", backward), ("fill_both", both)]
)
def test_fills(df, rows, mode, name, fn):
    out = getattr(ordered, name)(df, KEYS, ORDER, ["v"])
    assert out.columns == df.columns
    assert actual(out, "v") == expected(rows, fn)


def test_rank(df, rows, mode):
    out = ordered.rank_in_group(df, KEYS, ORDER)
    assert actual(out, "position") == expected(rows, lambda g: [(i + 1,) for i in range(len(g))])


def test_rank_of_everything(spark, mode):
    values = list(range(300))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    out = ordered.rank_in_group(df, [], ["v"])
    assert {r["v"]: r["position"] for r in out.collect()} == {v: v + 1 for v in range(300)}


def test_any_in_group(df, rows, mode):
    out = ordered.any_in_group(df, KEYS, ORDER, F.col("v") == 7777, "hit")
    assert {r["hit"] for r in out.collect()} == {False}
    one = next(r for r in rows if r[0] == 1 and r[5] is not None)
    flag = (F.col("trip") == 1) & (F.col("tie") == one[2])
    out = ordered.any_in_group(df, KEYS, ORDER, flag, "hit")
    assert {(r["trip"], r["hit"]) for r in out.collect()} == {
        (1, True),
        (2, False),
        (3, False),
        (4, False),
        (None, False),
    }


def test_edge_target_matches_definition(df, rows, mode):
    visits = df.withColumnsRenamed({"stop": "stop_id"})
    out = trips.edge_target(visits, "w", KEYS, ORDER)
    assert BLOCK not in out.columns

    def targets(group):
        last_of = {r[4]: i for i, r in enumerate(group)}
        return [
            (r[3], group[i + 1][3] if i + 1 < len(group) and last_of[r[4]] != i else None)
            for i, r in enumerate(group)
        ]

    known = [r for r in rows if r[0] is not None]
    assert actual(out, "source", "target") == expected(known, targets)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_keyed_join_same_with_heavy_keys(spark, small_limits, how, null_safe):
    left = spark.createDataFrame(make_rows(), SCHEMA)
    right_rows = [(1, "a"), (2, "b"), (2, "c"), (7, "d"), (None, "e")]
    right_rows += [(100 + i, "x") for i in range(20)]
    right = spark.createDataFrame(right_rows, "trip int, name string")
    got = keyed_join(left, right, KEYS, how, null_safe)
    other = right.withColumnRenamed("trip", "k")
    cond = left["trip"].eqNullSafe(other["k"]) if null_safe else left["trip"] == other["k"]
    want = left.join(other, cond, how).drop("k")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("heavy_on", ["right", "both"])
def test_fan_out_join_same_with_heavy_right_keys(spark, small_limits, heavy_on, null_safe):
    few = [(1, "a"), (2, "b"), (2, "c"), (8, "d"), (None, "e")]
    left_rows = few * (10 if heavy_on == "both" else 1)
    right_rows = [(k, i) for k in (1, 3, None) for i in range(40)] + [(2, 7), (9, 9)]
    left = spark.createDataFrame(left_rows, "trip int, name string")
    right = spark.createDataFrame(right_rows, "trip int, v int")
    got = fan_out_join(left, right, KEYS, null_safe)
    other = right.withColumnRenamed("trip", "k")
    cond = left["trip"].eqNullSafe(other["k"]) if null_safe else left["trip"] == other["k"]
    want = left.join(other, cond, "left").drop("k")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_fan_out_join_where_only_the_product_is_heavy(spark, small_limits, how):
    """Ten rows a side are far below the limit of 20, their hundred pairs are not."""
    left = spark.createDataFrame([(k % 3, i) for k in range(3) for i in range(10)], "trip int, a int")
    right = spark.createDataFrame([(k, i) for k in (0, 1) for i in range(10)], "trip int, b int")
    got = fan_out_join(left, right, KEYS, how=how)
    want = left.join(right, "trip", how)
    assert "explode" in got._jdf.queryExecution().toString().lower()
    assert sorted(map(str, got.select("trip", "a", "b").collect())) == sorted(
        map(str, want.select("trip", "a", "b").collect())
    )


def test_goldens_fill_and_target(spark):
    rows = [(1, i, 0, 0, 0, v) for i, v in enumerate([None, 5, None, 7, None])]
    df = spark.createDataFrame(rows, SCHEMA)

    def values(out):
        return [r["v"] for r in out.orderBy("seq").collect()]

    assert values(ordered.fill_forward(df, KEYS, ORDER, ["v"])) == [None, 5, 5, 7, 7]
    assert values(ordered.fill_both(df, KEYS, ORDER, ["v"])) == [5, 5, 5, 7, 7]
    for windows, want in [
        ([1, 1, 2, 2, 1], [2, 3, 4, None, None]),
        ([1, 1, 2, 2, 2], [2, None, 4, 5, None]),
    ]:
        rows = [(1, i, 0, i + 1, w, None) for i, w in enumerate(windows)]
        visits = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("stop", "stop_id")
        out = trips.edge_target(visits, "w", KEYS, ORDER).orderBy("seq").collect()
        assert [r["target"] for r in out] == want
        closed = trips.snapshot_end_rows(
            trips.edge_target(visits, "w", KEYS, ORDER), ["w"], KEYS, ORDER, per=[]
        )
        assert not any(r["open"] for r in closed.collect())


def test_displacement_and_trip_filters(spark):
    rows = [
        (1, 0, 0, 36.00, -86.0, 40.0, 0),
        (1, 1, 0, 36.01, -86.0, None, 0),
        (2, 0, 0, 36.00, -86.0, 40.0, 0),
        (2, 1, 0, None, -86.0, 40.0, 2),
        (None, 0, 0, 36.0, -86.0, 40.0, 3),
    ]
    df = spark.createDataFrame(
        rows,
        "trip int, seq int, tie int, map_latitude double, map_longitude double, "
        "vehicle_capacity double, b int",
    )
    km = trips.displacement(df, KEYS, ORDER).orderBy("trip", "seq").collect()
    assert [round(r["displacement"], 6) for r in km] == [1.111949, 0.0, 0.0, 0.0]
    kept = trips.drop_trips_any(df, F.col("vehicle_capacity").isNull(), KEYS, ORDER)
    assert {r["trip"] for r in kept.collect()} == {2}
    loaded = trips.keep_trips_with(df, F.col("b") > 0, KEYS, ORDER)
    assert {r["trip"] for r in loaded.collect()} == {2}
