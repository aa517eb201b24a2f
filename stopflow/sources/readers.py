"""Readers. Schemas are declared, never inferred; NaN is read as NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.functions import county_of, safe_ratio
from stopflow.functions.geometry import bounds
from stopflow.operators.cleaning import nan_to_null
from stopflow.sources import schemas
from stopflow.sources.documents import read_records

_POSITION = "array<double>"


def read_visits(spark: SparkSession, path: str, schema: str = schemas.VISITS) -> DataFrame:
    """Stop visits (or, with another schema, any parquet table of the model)."""
    return nan_to_null(spark.read.schema(schema).parquet(path))


def read_raw_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_visits(spark, path, schemas.RAW_COUNTS)


def read_routes(
    spark: SparkSession,
    root: str,
    route_ids: Sequence[int] | None = None,
    schema: str = schemas.VISITS,
) -> DataFrame:
    """All routes of a table partitioned by route, or only the directories of some."""
    visits = read_visits(spark, root, schema)
    return visits if route_ids is None else visits.where(F.col("route_id").isin(*route_ids))


def read_traffic(
    spark: SparkSession, path: str, year: int | None = None, month: int | None = None
) -> DataFrame:
    """Traffic readings, restricted to a year and month where given (partition pruning)."""
    traffic = read_visits(spark, path, schemas.TRAFFIC)
    for name, value in (("year", year), ("month", month)):
        if value is not None:
            traffic = traffic.where(F.col(name) == value)
    return traffic


def _features(spark: SparkSession, path: str, attributes: str, multi_line: bool) -> DataFrame:
    """One row per GeoJSON feature: its attributes, geometry type and raw coordinates.

    Files hold feature collections: one document per file (``multi_line``), which several tasks
    read together, or one collection per line.
    """
    fields = ", ".join(
        "{}:{}".format(*part.split()) for part in attributes.replace("\n", " ").split(",")
    )
    feature = f"STRUCT<properties:STRUCT<{fields}>,geometry:STRUCT<type:STRING,coordinates:STRING>>"
    if multi_line:
        records = read_records(spark, path, "features")
        rows = records.select(F.from_json("value", feature).alias("f"))
    else:
        doc = spark.read.schema(f"features ARRAY<{feature}>").json(path)
        rows = doc.select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", "f.geometry.type", "f.geometry.coordinates")


def _points(list_of_positions: Column) -> Column:
    return F.transform(
        list_of_positions, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat"))
    )


def _parts(single: str, multi: str, depth: int) -> Column:
    """Point lists of a geometry, with the parts of a multi-geometry side by side."""
    one, many = _POSITION, _POSITION
    for _ in range(depth):
        one = f"array<{one}>"
    many = f"array<{one}>"
    plain = F.from_json("coordinates", one)
    lists = {
        1: (F.array(plain), F.from_json("coordinates", many)),
        2: (plain, F.flatten(F.from_json("coordinates", many))),
    }[depth]
    chosen = F.when(F.col("type") == single, lists[0]).when(F.col("type") == multi, lists[1])
    return F.transform(chosen, _points)


def read_polygons(
    spark: SparkSession,
    path: str,
    attributes: str = schemas.TRACT_ATTRIBUTES,
    multi_line: bool = True,
) -> DataFrame:
    """Polygon layer: attributes, ``rings`` and bounding box. Coordinates must be EPSG:4326."""
    rows = _features(spark, path, attributes, multi_line)
    shaped = rows.withColumn("rings", _parts("Polygon", "MultiPolygon", 2))
    return nan_to_null(
        shaped.withColumns(bounds(F.col("rings"))).drop("type", "coordinates")
    )


def read_lines(
    spark: SparkSession,
    path: str,
    attributes: str = schemas.SEGMENT_ATTRIBUTES,
    id_col: str = "XDSegID",
    multi_line: bool = True,
) -> DataFrame:
    """Line layer: attributes with an integer id, ``paths`` and bounding box."""
    rows = _features(spark, path, attributes, multi_line)
    shaped = rows.withColumn("paths", _parts("LineString", "MultiLineString", 1))
    return shaped.withColumns(
        {id_col: F.col(id_col).cast("int"), **bounds(F.col("paths"))}
    ).drop("type", "coordinates")


def tract_profile(polygons: DataFrame) -> DataFrame:
    """Tract columns used by the model: county, transit share for work, missing numbers as 0."""
    share = safe_ratio(
        "no_public_transport_for_work", "total_surveyed_public_transportation_for_work"
    )
    numbers = (
        "median_income_last12months",
        "white_pct",
        "black_pct",
        "hispanic_pct",
        "public_transit_pct",
    )
    return polygons.select(
        "GEOID",
        county_of("NAME").alias("county_name"),
        share.alias("pct_public_transit_for_work"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numbers],
        "rings",
        "xmin",
        "ymin",
        "xmax",
        "ymax",
    )


def read_weather(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Weather readings: one JSON object per line, or one array per file (``multi_line``), which
    several tasks read together."""
    if multi_line:
        parsed = F.from_json("value", schemas.WEATHER, {"mode": "PERMISSIVE"})
        return nan_to_null(read_records(spark, path).select(parsed.alias("w")).select("w.*"))
    return nan_to_null(spark.read.schema(schemas.WEATHER).json(path))


def read_csv(
    spark: SparkSession, path: str, schema: str, index_col: bool = True
) -> DataFrame:
    """CSV with a header; a leading unnamed index column is read over."""
    full = f"_index INT, {schema}" if index_col else schema
    table = spark.read.schema(full).option("header", True).csv(path)
    return nan_to_null(table.drop("_index"))


def read_predictions(spark: SparkSession, path: str, index_col: bool = True) -> DataFrame:
    return read_csv(spark, path, schemas.PREDICTIONS, index_col)


def read_history(spark: SparkSession, path: str, index_col: bool = True) -> DataFrame:
    return read_csv(spark, path, schemas.HISTORY, index_col)
