"""Aggregates over visits, labels and snapshots. All combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopflow.operators.skew import adaptive_join
from stopflow.operators.trips import with_key

# Past and future visits a group must hold to be usable.
PAST, FUTURE = 3, 1
RECURRING = (
    "new_time_window",
    "block_abbr",
    "route_id",
    "route_direction_name",
    "stop_id",
    "dayofweek",
)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def time_bounds(df: DataFrame, col: str = "datetime") -> DataFrame:
    """First and last timestamp."""
    return df.agg(F.min(col).alias("first_time"), F.max(col).alias("last_time"))


def _small_groups(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    sizes = with_key(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.where(F.col("_rows") < n)


def flag_small_groups(
    df: DataFrame, keys: Sequence[str] = RECURRING, n: int = PAST + FUTURE
) -> DataFrame:
    """Flag rows whose group has fewer than ``n`` rows; rows without a full key are dropped.

    Only the small groups are joined back, never the large ones.
    """
    small = _small_groups(df, keys, n).select(*keys, F.lit(True).alias("_small"))
    out = adaptive_join(with_key(df, keys), small, keys)
    flag = F.coalesce("_small", F.lit(False)).alias("remove_trip_condn")
    return out.select(*[c for c in out.columns if c != "_small"], flag)


def any_small_group(
    df: DataFrame, keys: Sequence[str] = RECURRING, n: int = PAST + FUTURE
) -> DataFrame:
    """One Boolean: does any group have fewer than ``n`` rows?"""
    return _small_groups(df, keys, n).agg((F.count(F.lit(1)) > 0).alias("any_small"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def class_grid(spark: SparkSession, classes: int) -> DataFrame:
    """The classes 0 .. classes-1."""
    return spark.range(classes).select(F.col("id").cast("int").alias("y"))


def class_histogram(nodes: DataFrame, classes: int = 5) -> DataFrame:
    """Labels per class over all snapshots, absent classes with 0."""
    counts = nodes.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    grid = class_grid(nodes.sparkSession, classes)
    return grid.join(counts, "y", "left").select(
        "y", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def class_percentages(nodes: DataFrame, split: str = "split") -> DataFrame:
    """Share of each class within each split, in percent."""
    counts = nodes.groupBy(split, "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(split))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def class_weights(nodes: DataFrame) -> DataFrame:
    """Total over count, per class present."""
    # The window runs over the per-class counts: one row per class.
    counts = nodes.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("weight", total / F.col("n"))


def distinct_per_day(visits: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of a column per transit date."""
    return visits.groupBy("transit_date").agg(F.countDistinct(col).alias(name))


def join_day_stats(visits: DataFrame, window_col: str) -> DataFrame:
    """Distinct routes and distinct windows per transit date, side by side."""
    routes = distinct_per_day(visits, "route_id", "n_routes")
    windows = distinct_per_day(visits, window_col, "n_windows")
    return routes.join(windows, "transit_date")


def top_days(visits: DataFrame, window_col: str, k: int = 10) -> DataFrame:
    """The k days with most routes, then most windows, then earliest."""
    days = join_day_stats(visits, window_col)
    return days.orderBy(F.desc("n_routes"), F.desc("n_windows"), "transit_date").limit(k)


def stop_positions(
    visits: DataFrame, order: Sequence[str], keep: Column | None = None
) -> DataFrame:
    """First known longitude and, separately, first known latitude of every stop."""
    rows = visits if keep is None else visits.where(keep)
    place = F.struct(*order)

    def first_known(col: str) -> Column:
        return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), place)).alias(col)

    return rows.groupBy("stop_id").agg(
        first_known("map_longitude"), first_known("map_latitude")
    )
