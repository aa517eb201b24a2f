"""Chebyshev neighbour aggregates of node features, per snapshot.

With the scaled Laplacian ``L = -D^-1/2 A D^-1/2`` (largest eigenvalue taken as 2, self-loops
ignored): ``T0 = X``, ``T1 = L X``, ``Tk = 2 L T(k-1) - T(k-2)``. ``D`` is the sum of outgoing
edge weights and messages run from source to target. See Defferrard et al. 2016.

Edges and terms lie in buckets of (snapshot, stop), as many as a shuffle has partitions. A round reads both
where they lie, exchanges only the messages, and writes the next term into the same buckets; the
terms meet without an exchange at the end. A hub with very many edges makes a large bucket on the edge
side only, and its messages are summed up before they move.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.operators.snapshots import EDGE, FEATURES, NODE, SNAPSHOT
from stopflow.session import scratch_path

SOURCE = (*SNAPSHOT, "source")


def normalised_edges(edges: DataFrame, weight: str = "displacement") -> DataFrame:
    """Edges with their entry of the scaled Laplacian; a node without weight gives 0."""
    plain = edges.where(F.col("source") != F.col("target")).select(
        *EDGE, F.col(weight).cast("double").alias("_w")
    )
    degree = plain.groupBy(*SNAPSHOT, "source").agg(F.sum("_w").alias("_deg"))
    out = plain
    for end in ("source", "target"):
        ends = degree.select(
            *SNAPSHOT, F.col("source").alias(end), F.col("_deg").alias(f"_deg_{end}")
        )
        out = out.join(ends, [*SNAPSHOT, end], "left")
    both = F.col("_deg_source") * F.col("_deg_target")
    usable = (F.col("_deg_source") > 0) & (F.col("_deg_target") > 0)
    norm = F.when(usable, -F.col("_w") / F.sqrt(both)).otherwise(F.lit(0.0))
    return out.select(*EDGE, norm.alias("_norm"))


def bucketed(df: DataFrame, keys: Sequence[str], name: str, dealt: bool = False) -> DataFrame:
    """Write to the shared folder in buckets of the keys; joins on them then need no exchange.

    ``dealt`` rows are partitioned by the keys already.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"stopflow_{name}_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, *keys)
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    # The frame holds the files; only the name in the catalog goes.
    spark.sql(f"DROP TABLE {table}")
    return out


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join of two frames in the same buckets, by merging."""
    return left.hint("merge").join(right, list(keys), how)


def next_term(
    norm: DataFrame, last: DataFrame, prior: DataFrame | None, cols: Sequence[str]
) -> DataFrame:
    """The term behind ``last`` and ``prior``, of edges and terms in buckets; one exchange."""
    sources = last.withColumnRenamed("stop_id", "source")
    moved = (
        _met(norm, sources, SOURCE, "inner")
        .groupBy(*SNAPSHOT, F.col("target").alias("stop_id"))
        .agg(*[F.sum(F.col("_norm") * F.col(c)).alias(f"_m_{c}") for c in cols])
    )
    known = last.select(*NODE) if prior is None else prior
    # Both sides hold each (snapshot, stop) once.
    both = _met(known, moved, NODE, "left")
    got = {c: F.coalesce(f"_m_{c}", F.lit(0.0)) for c in cols}
    new = got if prior is None else {c: 2 * got[c] - F.col(c) for c in cols}
    return both.select(*NODE, *[v.alias(c) for c, v in new.items()])


def khop(
    nodes: DataFrame,
    edges: DataFrame,
    k: int = 3,
    cols: Sequence[str] = FEATURES,
    weight: str = "displacement",
) -> DataFrame:
    """Columns ``t0_<feature>`` .. ``t<k-1>_<feature>`` per (snapshot, stop)."""
    first = nodes.select(*NODE, *[F.col(c).cast("double").alias(c) for c in cols])
    terms = [bucketed(first, NODE, "terms")]
    if k > 1:
        norm = bucketed(normalised_edges(edges, weight), SOURCE, "laplacian")
    for step in range(1, k):
        prior = terms[step - 2] if step > 1 else None
        term = next_term(norm, terms[-1], prior, cols)
        terms.append(bucketed(term, NODE, "terms", dealt=True))
    named = [
        t.select(*NODE, *[F.col(c).alias(f"t{i}_{c}") for c in cols]) for i, t in enumerate(terms)
    ]
    out = named[0]
    for t in named[1:]:
        out = _met(out, t, NODE, "inner")
    return out
