import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stopflow.functions.geometry import point_in_rings
from stopflow.operators.spatial import nearest_line, within
from stopflow.sources.readers import read_lines, read_polygons

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
WORLD = [[-100, -80], [100, -80], [100, 80], [-100, 80], [-100, -80]]
FAR = [[10, 10], [11, 10], [10, 11], [10, 10]]


def feature(kind, coordinates, **properties):
    return {
        "type": "Feature",
        "properties": properties,
        "geometry": {"type": kind, "coordinates": coordinates},
    }


@pytest.fixture
def polygons(spark, tmp_path):
    layer = {
        "type": "FeatureCollection",
        "features": [
            feature("Polygon", [SQUARE, HOLE], GEOID="1", white_pct=5),
            feature("MultiPolygon", [[SQUARE], [FAR]], GEOID="2", white_pct=None),
            feature("Polygon", [WORLD], GEOID="3"),
            feature("Polygon", [[[4, 0], [8, 0], [8, 4], [4, 4], [4, 0]]], GEOID="4"),
        ],
    }
    path = tmp_path / "tracts.geojson"
    path.write_text(json.dumps(layer, indent=2))
    return read_polygons(spark, str(path))


def points(spark, pairs):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "id int, map_longitude double, map_latitude double")


def test_read_polygons(polygons):
    got = {r["GEOID"]: r for r in polygons.collect()}
    assert [len(ring) for ring in got["1"]["rings"]] == [5, 5]
    assert [len(ring) for ring in got["2"]["rings"]] == [5, 4]
    assert (got["2"]["xmin"], got["2"]["ymax"]) == (0.0, 11.0)
    assert got["1"]["white_pct"] == 5.0 and got["2"]["white_pct"] is None


@pytest.mark.parametrize("limits", ["default", "small"])
def test_within_holes_parts_and_sizes(request, spark, polygons, limits):
    if limits == "small":
        request.getfixturevalue("small_limits")
    pts = points(spark, [(0.5, 0.5), (1.5, 1.5), (10.2, 10.2), (10.9, 10.9), (150, 0)] * 9)
    pts = pts.unionByName(
        spark.createDataFrame([(99, None, 1.0)], pts.schema)
    )
    got = {}
    for r in within(pts, polygons, ["GEOID"]).collect():
        got.setdefault(r["id"] % 5, []).append(r["GEOID"])
    assert {k: sorted(set(v)) for k, v in got.items()} == {
        0: ["1", "2", "3"],
        1: ["2", "3"],
        2: ["2", "3"],
        3: ["3"],
    }
    assert len(got[0]) == 27


def test_shared_border_belongs_to_one_side(spark, polygons):
    pts = points(spark, [(4, 1), (4, 3)])
    pair = polygons.where(F.col("GEOID").isin("1", "4"))
    got = [r["GEOID"] for r in within(pts, pair, ["GEOID"]).collect()]
    assert got == ["4", "4"]


def test_within_equals_brute_force(spark):
    rng = random.Random(5)
    shapes = []
    for i in range(40):
        n, cx, cy = rng.randrange(3, 9), rng.uniform(-3, 3), rng.uniform(-3, 3)
        size = rng.choice([0.05, 0.3, 2.5])
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(cx + size * math.cos(a), cy + size * math.sin(a)) for a in angles]
        ring.append(ring[0])
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        shapes.append((i, [ring], min(xs), min(ys), max(xs), max(ys)))
    schema = (
        "GEOID int, rings array<array<struct<lon:double,lat:double>>>, "
        "xmin double, ymin double, xmax double, ymax double"
    )
    polys = spark.createDataFrame(shapes, schema)
    pts = points(spark, [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(200)])
    joined = within(pts, polys, ["GEOID"]).select("id", "GEOID")
    inside = point_in_rings(F.col("map_longitude"), F.col("map_latitude"), F.col("rings"))
    brute = pts.join(polys, inside).select("id", "GEOID")
    want = sorted(map(tuple, brute.collect()))
    assert len(want) > 50
    assert sorted(map(tuple, joined.collect())) == want


def test_nearest_line(spark, tmp_path):
    layer = {
        "type": "FeatureCollection",
        "features": [
            feature("LineString", [[0, 0], [0.01, 0]], XDSegID="7"),
            feature(
                "MultiLineString",
                [[[5, 5], [5, 6]], [[0, 0.0015], [0.01, 0.0015]]],
                XDSegID="3",
            ),
            feature("LineString", [[0.02, 0], [0.02, 0]], XDSegID="9"),
        ],
    }
    path = tmp_path / "roads.geojson"
    path.write_text(json.dumps(layer))
    lines = read_lines(spark, str(path))
    pts = points(spark, [(0.005, 0.0005), (0.005, 0.0045), (0.005, 0.00075), (5, 5.5), (0.0205, 0)])
    pts = pts.unionByName(spark.createDataFrame([(99, None, None)], pts.schema))
    got = {r["id"]: r["XDSegID"] for r in nearest_line(pts, lines).collect()}
    # The third point is equally far from both lines: the smaller id wins.
    assert got == {0: 7, 1: None, 2: 3, 3: 3, 4: 9, 99: None}


def test_dense_cell_and_huge_polygon(spark, small_limits):
    """Many points and shapes in one spot, next to a shape of 20,000 corners over all of them."""
    turn = [2 * math.pi * k / 20_000 for k in range(20_000)]
    ring = [(math.cos(t), math.sin(t)) for t in turn]
    shapes = [("huge", [[*ring, ring[0]]], -1.0, -1.0, 1.0, 1.0)]
    for k in range(60):
        x0, y0, side = 0.1 + k * 1e-5, 0.1, 1e-3
        box = [(x0, y0), (x0 + side, y0), (x0 + side, y0 + side), (x0, y0 + side), (x0, y0)]
        shapes.append((f"s{k}", [box], x0, y0, x0 + side, y0 + side))
    schema = (
        "GEOID string, rings array<array<struct<lon: double, lat: double>>>, "
        "xmin double, ymin double, xmax double, ymax double"
    )
    polygons = spark.createDataFrame(shapes, schema)
    spots = [(i, 0.1 + (i % 40) * 3e-5 + 1e-6, 0.1 + (i // 40) * 7e-5 + 1e-6) for i in range(400)]
    points = spark.createDataFrame(spots, "id int, map_longitude double, map_latitude double")
    got = {(r.id, r.GEOID) for r in within(points, polygons, ["GEOID"]).collect()}
    want = {
        (i, name)
        for i, x, y in spots
        for name, _, x0, y0, x1, y1 in shapes
        if name == "huge" or (x0 <= x < x1 and y0 <= y < y1)
    }
    assert got == want


RINGS = (
    "GEOID string, rings array<array<struct<lon: double, lat: double>>>, "
    "xmin double, ymin double, xmax double, ymax double"
)


def moves_arrays_of_points(df):
    """Columns of those exchanges of a plan that carry geometry."""
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append(node.schema().simpleString())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(plan)
    assert found
    return [s for s in found if "array<" in s.replace("_strips:array<int>", "")]


def wavy_ring(n, cx, cy, size, rng):
    """A star-shaped ring of many corners, some edges far longer than others."""
    angles = [2 * math.pi * k / n for k in range(n)]
    reach = [size * (1 + 0.3 * math.sin(40 * a) + rng.uniform(-0.2, 0.2)) for a in angles]
    ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, reach, strict=True)]
    return [*ring, ring[0]]


def even_odd(x, y, rings):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1
    return n % 2 == 1


def test_long_rings_holes_and_parts_equal_brute_force(spark):
    rng = random.Random(8)
    shapes = {
        "long": [wavy_ring(10_000, 0, 0, 2, rng), wavy_ring(500, 0.2, 0.1, 0.4, rng)],
        "parts": [wavy_ring(30, 3, 3, 0.5, rng), wavy_ring(7, -3, 2, 0.7, rng), wavy_ring(4, 3, 3, 0.1, rng)],
        "thin": [[(-4, 0), (4, 1e-7), (4, 2e-7), (-4, 1e-7), (-4, 0)]],
        "comb": [[(k * 0.01, 3.0 * (k % 2)) for k in range(400)] + [(4, -1), (0, -1), (0, 0)]],
        "none": [],
        "null": None,
    }
    rows = []
    for name, rings in shapes.items():
        xs = [p[0] for r in rings or [] for p in r] or [None]
        ys = [p[1] for r in rings or [] for p in r] or [None]
        box = [None] * 4 if xs == [None] else [float(v) for v in (min(xs), min(ys), max(xs), max(ys))]
        rows += [(name, [[(float(x), float(y)) for x, y in r] for r in rings] if rings is not None else None, *box)] * (1 + (name == "parts"))
    polys = spark.createDataFrame(rows, RINGS)
    pairs = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(600)] + [(0.0, 1.2e-7), (1.0, 1.5)]
    joined = within(points(spark, pairs), polys, ["GEOID"]).select("id", "GEOID")
    got = sorted(map(tuple, joined.collect()))
    want = sorted(
        (i, name)
        for i, (x, y) in enumerate(pairs)
        for name, rings in shapes.items()
        if rings and even_odd(x, y, rings)
        for _ in range(1 + (name == "parts"))
    )
    assert got == want and len({n for _, n in want}) == 4
    assert moves_arrays_of_points(joined) == []


def test_long_diagonal_line_equals_brute_force(spark):
    rng = random.Random(9)
    path = [(k * 1e-3, k * 1e-3 + rng.uniform(-2e-4, 2e-4)) for k in range(10_001)]
    far = [(0.0, 5.0), (10.0, 5.0)]
    back = [(x + 3e-4, y) for x, y in reversed(path[:50])]
    lines = {7: [path], 3: [far, back], 9: [[(2.0, 2.5)], [(1.0, 1.5), (1.0, 1.5)]], 11: []}
    df = spark.createDataFrame(
        list(lines.items()), "XDSegID int, paths array<array<struct<lon: double, lat: double>>>"
    )
    pairs = [(x + rng.uniform(-1e-3, 1e-3), y + rng.uniform(-1e-3, 1e-3)) for x, y in rng.sample(path, 150)]
    pairs += [(5.0, 5.0), (5.0, 5.0004), (9.99, 5.0009), (1.0, 1.5003), (50.0, 50.0)]

    def away(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0.0
        ex, ey = x - (a[0] + t * dx), y - (a[1] + t * dy)
        return math.sqrt(ex * ex + ey * ey)

    joined = nearest_line(points(spark, pairs), df, 5e-4)
    got = {r["id"]: r["XDSegID"] for r in joined.collect()}
    want = {}
    for i, (x, y) in enumerate(pairs):
        near = [
            (d, k)
            for k, paths in lines.items()
            for p in paths
            for a, b in zip(p, p[1:], strict=False)
            if (d := away(x, y, a, b)) < 5e-4
        ]
        want[i] = min(near)[1] if near else None
    assert got == want and {3, 7, 9, None} <= set(want.values())
    assert moves_arrays_of_points(joined) == []
