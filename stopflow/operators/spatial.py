"""Spatial joins as equi-joins on grid keys, with the exact test on single edges.

Visits repeat the coordinates of their stop, so the geometry is tested once per distinct
coordinate pair. No ring or path enters an exchange: shapes are taken apart into edges where they
are read, and what meets a coordinate pair are the few edges that can matter to it.

* Polygons: ids and boxes sit on a hierarchical grid (the width of a box chooses its level, so it
  covers at most four cells). The edges of a shape sit in latitude strips, again by level: strips are
  at least as high as the edge, so it lies in two at most. A pair whose box holds the point
  meets the edges of one strip per level; the point is inside where they are crossed an odd number
  of times.
* Lines: every leg is cut into pieces of at most two radii, kept by the cell of their middle. A
  point asks the nine cells around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stopflow.functions.geometry import crossed, legs, segment_distance
from stopflow.operators.skew import adaptive_join
from stopflow.session import stored

# Levels double in width or height; the finest, level 0, is about 1e-5 degrees.
FINEST, LEVELS = 2.0**-17, 40
CELL = ["_level", "_cx", "_cy"]
STRIP = ["_shape", "_level", "_strip"]
SHAPE = "_shape"
# Cells are wider than two radii by this much, so that rounding misses none.
SLACK = 1e-6


def _level(extent: Column) -> Column:
    """The finest level whose step is not below the extent."""
    level = F.ceil(F.log2(F.greatest(extent, F.lit(FINEST)) / FINEST))
    return F.least(level, F.lit(LEVELS - 1)).cast("int")


def _index(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(FINEST) * F.pow(F.lit(2.0), level))).cast("long")


def _between(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def _numbered(polygons: DataFrame) -> tuple[DataFrame, list[int]]:
    """Stored shapes with an id, their grid level and the strip levels of their edges, and the grid
    levels in use."""
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    heights = F.transform(legs(F.col("rings")), lambda e: _level(F.abs(e["by"] - e["ay"])))
    rows = polygons.where(wide.isNotNull()).withColumns(
        {
            SHAPE: F.monotonically_increasing_id(),
            "_level": _level(wide),
            "_strips": F.array_distinct(heights),
        }
    )
    seen = Observation()
    bits = F.bit_or(F.expr("shiftleft(1L, _level)"))
    shapes = stored(rows.observe(seen, bits.alias("bits")), "shapes")
    bits = seen.get["bits"] or 0
    return shapes, [k for k in range(LEVELS) if bits >> k & 1]


def _cover(shapes: DataFrame) -> DataFrame:
    """Ids and boxes, once per grid cell the box touches."""
    boxes = shapes.select(SHAPE, "_level", "_strips", "xmin", "ymin", "xmax", "ymax")
    for low, high, cell in (("xmin", "xmax", "_cx"), ("ymin", "ymax", "_cy")):
        at = [_index(F.col(c), F.col("_level")) for c in (low, high)]
        boxes = boxes.withColumn(cell, _between(*at))
    return boxes


def _edges(shapes: DataFrame) -> DataFrame:
    """The edges of all rings, once per latitude strip they touch; level ones are never crossed."""
    edge = shapes.select(SHAPE, F.explode(legs(F.col("rings"))).alias("_e")).select(SHAPE, "_e.*")
    placed = edge.where("ay != by").withColumn("_level", _level(F.abs(F.col("by") - F.col("ay"))))
    at = [_index(pick("ay", "by"), F.col("_level")) for pick in (F.least, F.greatest)]
    return placed.withColumn("_strip", _between(*at))


def _spots(points: DataFrame, lon: str, lat: str) -> DataFrame:
    known = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    return points.select(lon, lat).where(known).distinct()


def within(
    points: DataFrame,
    polygons: DataFrame,
    attrs: list[str],
    lon: str = "map_longitude",
    lat: str = "map_latitude",
) -> DataFrame:
    """Inner join: attach polygon attributes, drop points outside every polygon.

    A point in several polygons is kept once for each. Border points are half-open (see
    ``geometry.crossed``), so adjacent polygons never share one.
    """
    shapes, levels = _numbered(polygons)
    used = F.array(*[F.lit(v) for v in levels]).cast("array<int>")
    spots = _spots(points, lon, lat).withColumn("_level", F.explode(used))
    spots = spots.withColumns(
        {c: _index(F.col(v), F.col("_level")) for c, v in (("_cx", lon), ("_cy", lat))}
    )
    in_box = F.col(lon).between(F.col("xmin"), F.col("xmax"))
    in_box &= F.col(lat).between(F.col("ymin"), F.col("ymax"))
    near = adaptive_join(spots, _cover(shapes), CELL, "inner").where(in_box)
    asked = near.select(lon, lat, SHAPE, F.explode("_strips").alias("_level"))
    asked = asked.withColumn("_strip", _index(F.col(lat), F.col("_level")))
    met = adaptive_join(asked, _edges(shapes), STRIP, "inner")
    crossings = F.count_if(crossed(F.col(lon), F.col(lat), *map(F.col, ("ax", "ay", "bx", "by"))))
    inside = met.groupBy(lon, lat, SHAPE).agg(crossings.alias("_n")).where("_n % 2 = 1")
    answers = adaptive_join(inside.drop("_n"), shapes.select(SHAPE, *attrs), [SHAPE], "inner")
    return adaptive_join(points, answers.drop(SHAPE), [lon, lat], "inner")


def _pieces(lines: DataFrame, id_col: str, radius: float) -> DataFrame:
    """Whole legs, once for every piece of them, in the cell of the middle of the piece."""
    leg = lines.select(id_col, F.explode(legs(F.col("paths"))).alias("_e")).select(id_col, "_e.*")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / (2 * radius)), F.lit(1)).cast("long")
    cut = leg.where((dx + dy).isNotNull()).withColumn("_n", n)
    cut = cut.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    middle = (F.col("_k") + 0.5) / F.col("_n")
    cells = {"_cx": F.col("ax") + middle * dx, "_cy": F.col("ay") + middle * dy}
    return cut.withColumns({c: _cell(v, radius) for c, v in cells.items()}).drop("_n", "_k")


def _cell(value: Column, radius: float) -> Column:
    return F.floor(value / (2 * radius * (1 + SLACK))).cast("long")


def nearest_line(
    points: DataFrame,
    lines: DataFrame,
    radius: float = 0.001,
    id_col: str = "XDSegID",
    lon: str = "map_longitude",
    lat: str = "map_latitude",
) -> DataFrame:
    """Left join: the nearest line closer than ``radius`` degrees, smallest id on ties."""
    spots = _spots(points, lon, lat)
    for c, v in (("_cx", lon), ("_cy", lat)):
        own = _cell(F.col(v), radius)
        spots = spots.withColumn(c, _between(own - 1, own + 1))
    met = adaptive_join(spots, _pieces(lines, id_col, radius), ["_cx", "_cy"], "inner")
    away = segment_distance(*map(F.col, (lon, lat, "ax", "ay", "bx", "by")))
    met = met.withColumn("_away", away).where(F.col("_away") < radius)
    best = met.groupBy(lon, lat).agg(F.min(F.struct("_away", id_col)).alias("_best"))
    found = best.select(lon, lat, F.col("_best")[id_col].alias(id_col))
    return adaptive_join(points, found, [lon, lat], "left")
