"""Planar geometry on ``array<struct<lon,lat>>`` columns.

Coordinates are degrees (EPSG:4326) treated as a plane. A polygon is the list of all its rings
(outer rings, holes and parts alike); the even-odd rule over all of them is exact for valid
polygons and multipolygons. A line is a list of paths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(points: Column) -> Column:
    """1 .. n-1, or an empty array for fewer than two points."""
    n = F.size(points)
    return F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(
        F.array().cast("array<int>")
    )


def legs(parts: Column) -> Column:
    """All edges ``ax, ay, bx, by`` of a ring list or path list, side by side."""

    def of(part: Column) -> Column:
        def leg(i: Column) -> Column:
            a, b = F.get(part, i - 1), F.get(part, i)
            ends = (a["lon"], "ax"), (a["lat"], "ay"), (b["lon"], "bx"), (b["lat"], "by")
            return F.struct(*[value.alias(name) for value, name in ends])

        return F.transform(_steps(part), leg)

    return F.flatten(F.transform(parts, of))


def crossed(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray from the point towards greater longitude crosses the edge a-b.

    A point on a border is in on low edges, out on high ones; odd counts are inside.
    """
    spans = (ay > lat) != (by > lat)
    at = F.try_divide(lat - ay, by - ay)
    return spans & (lon < ax + at * (bx - ax))


def ring_crossings(lon: Column, lat: Column, ring: Column) -> Column:
    """How many ring edges a ray from the point towards greater longitude crosses."""

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i - 1), F.get(ring, i)
        return crossed(lon, lat, a["lon"], a["lat"], b["lon"], b["lat"])

    return F.aggregate(
        _steps(ring),
        F.lit(0),
        lambda n, i: n + F.coalesce(crosses(i).cast("int"), F.lit(0)),
    )


def point_in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd containment. Border points are half-open: in on low edges, out on high ones."""
    total = F.aggregate(
        F.transform(rings, lambda ring: ring_crossings(lon, lat, ring)),
        F.lit(0),
        lambda n, k: n + k,
    )
    return F.pmod(total, F.lit(2)) == 1


def segment_distance(
    px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column
) -> Column:
    """Distance from a point to the closed segment a-b."""
    dx, dy = bx - ax, by - ay
    along = F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def bounds(parts: Column) -> dict[str, Column]:
    """Bounding box columns ``xmin, ymin, xmax, ymax`` of a ring list or path list."""
    points = F.flatten(parts)
    lons = F.transform(points, lambda p: p["lon"])
    lats = F.transform(points, lambda p: p["lat"])
    return {
        "xmin": F.array_min(lons),
        "ymin": F.array_min(lats),
        "xmax": F.array_max(lons),
        "ymax": F.array_max(lats),
    }
