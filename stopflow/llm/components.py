"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: tie the neighbours of each node to the smallest of them."""
    if large:
        near = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(low, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    own = low.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return (
        tied.select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(own)
        .where("a != b")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (from larger to smaller ends) are stars already."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").agg(F.count("*")).first()[0] == 0


def stars(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b) but the smallest of its component.

    Alternates the large and the small star until the edges are stars. Every round is written to
    the shared folder, so a lost executor repeats one round at most. Loops and repeated edges
    have no effect; a missing end drops the edge.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    edges = stored(edges, "edges")
    while True:
        edges = stored(_star(_star(edges, True), False), "stars")
        if _settled(edges):
            return edges.toDF("node", "component")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is its smallest member."""
    tied = stars(edges)
    return tied.union(tied.select("component", "component").distinct())
