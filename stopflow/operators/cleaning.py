"""Row-level cleaning: duplicates, missing values, audits of missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENT_COLUMNS = ("white_pct", "black_pct", "hispanic_pct", "public_transit_pct")
WEATHER_AND_TRAFFIC = (
    "precipitation_intensity",
    "temperature",
    "humidity",
    "xd_id",
    "average_speed",
    "reference_speed",
    "congestion",
    "extreme_congestion",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column, so that averages skip it."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return df.dropDuplicates()


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a total order.

    The rank filter reaches below the exchange (a group limit on the map side), so at most one
    row per key and task is shuffled, whatever the number of copies.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def drop_nulls(df: DataFrame, cols: Sequence[str] = WEATHER_AND_TRAFFIC) -> DataFrame:
    """Drop rows with NULL in any of the columns.

    One predicate per column: after a left join each can move to its own side and turn the
    join into an inner one, which a combined count of NULLs cannot.
    """
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def fill_constant(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """Replace NULL by a constant, per column."""
    return df.fillna(dict(values))


def percent_to_fraction(df: DataFrame, cols: Sequence[str] = PERCENT_COLUMNS) -> DataFrame:
    return df.withColumns({c: F.col(c) / 100 for c in cols})


def null_audit(visits: DataFrame) -> DataFrame:
    """Routes with missing coordinates, and how many coordinates and delays each lacks."""
    missing = {
        "null_latitude": "map_latitude",
        "null_longitude": "map_longitude",
        "null_delay": "delay",
    }
    counts = visits.groupBy("route_id").agg(
        *[F.count_if(F.col(c).isNull()).alias(name) for name, c in missing.items()]
    )
    return counts.where((F.col("null_latitude") > 0) | (F.col("null_longitude") > 0))


def null_rows(df: DataFrame, col: str = "congestion") -> DataFrame:
    """Rows where a column is missing."""
    return df.where(F.col(col).isNull())
