"""Writers. Partitioned tables are rebalanced first: a large partition value is written by
several tasks and small ones share a task, so file sizes stay even under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _partitioned(df: DataFrame, path: str, col: str, mode: str) -> None:
    df.hint("rebalance", col).write.mode(mode).partitionBy(col).parquet(path)


def write_by_route(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per route."""
    _partitioned(df, path, "route_id", mode)


def write_traffic(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per year and month."""
    balanced = df.hint("rebalance", "year", "month")
    balanced.write.mode(mode).partitionBy("year", "month").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows as JSON lines."""
    df.write.mode(mode).json(path)


def write_documents(
    records: DataFrame, path: str, documents: int, head: str = "[", tail: str = "]"
) -> None:
    """JSON documents, each an array of its share of the records (JSON text in ``value``).

    A task writes a document as a whole, so ``documents`` is to grow with the records. ``head`` and
    ``tail`` are what stands around the elements.
    """
    document = F.pmod(F.xxhash64("value"), F.lit(documents)).cast("int").alias("document")
    first = F.row_number().over(Window.partitionBy("document").orderBy("value")) == 1
    body = F.concat(F.when(first, "").otherwise(","), "value")
    part = F.when(first, 1).otherwise(2)
    rows = records.select(document, "value").select(
        "document", part.alias("_part"), body.alias("value")
    )
    ends = records.sparkSession.range(documents).select(
        F.col("id").cast("int").alias("document"),
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("_part"), F.lit(v).alias("value")) for k, v in ((0, head), (3, tail))])
        ).alias("_e"),
    )
    every = rows.unionByName(ends.select("document", "_e.*"))
    placed = every.repartition("document").sortWithinPartitions("document", "_part", "value")
    placed.select("document", "value").write.partitionBy("document").text(path)


COLLECTION = '{"type": "FeatureCollection", "features": [', "]}"


def write_collections(features: DataFrame, path: str, documents: int) -> None:
    """GeoJSON feature collections of features given as JSON text in ``value``."""
    write_documents(features, path, documents, *COLLECTION)
