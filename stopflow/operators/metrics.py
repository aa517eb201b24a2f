"""Evaluation of predictions: ``ytrue``/``ypred`` rows in, small metric tables out.

Everything is derived from the counts per (true, predicted) pair, so the rows are read once and
reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.operators.skew import adaptive_join

NO_BUS = 4


def pair_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("ytrue", "ypred").agg(F.count(F.lit(1)).alias("n"))


def confusion(preds: DataFrame, classes: int = 4) -> DataFrame:
    """Counts on the full grid of classes."""
    cell = F.col("id").cast("int")
    grid = preds.sparkSession.range(classes * classes).select(
        F.floor(cell / classes).cast("int").alias("ytrue"), (cell % classes).alias("ypred")
    )
    counted = grid.join(pair_counts(preds), ["ytrue", "ypred"], "left")
    return counted.select("ytrue", "ypred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_row_pct(preds: DataFrame, classes: int = 4) -> DataFrame:
    """Confusion counts as percentages of their true class; NULL for an empty class."""
    total = F.sum("n").over(Window.partitionBy("ytrue"))
    counts = confusion(preds, classes)
    return counts.withColumn("pct", F.try_divide(F.col("n") * 100.0, total))


def accuracy(preds: DataFrame) -> DataFrame:
    """Share of rows predicted exactly."""
    return preds.agg(F.avg((F.col("ytrue") == F.col("ypred")).cast("int")).alias("accuracy"))


def per_class_scores(preds: DataFrame, k: int = 4) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined scores are 0.

    ``closeness`` sums ``1 - |true - predicted| / k`` over the rows of the true class.
    """
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("ytrue") == F.col("ypred"), n).otherwise(none)
    close = n * (1 - F.abs(F.col("ytrue") - F.col("ypred")) / k)
    sides = F.array(
        F.struct(
            F.col("ytrue").alias("y"),
            n.alias("support"),
            none.alias("predicted"),
            hit.alias("hit"),
            close.alias("closeness"),
        ),
        F.struct(
            F.col("ypred").alias("y"),
            none.alias("support"),
            n.alias("predicted"),
            none.alias("hit"),
            F.lit(0.0).alias("closeness"),
        ),
    )
    totals = ("support", "predicted", "hit", "closeness")
    per_class = (
        pair_counts(preds)
        .select(F.inline(sides))
        .groupBy("y")
        .agg(*[F.sum(c).alias(c) for c in totals])
    )
    found, support, predicted = F.col("hit"), F.col("support"), F.col("predicted")
    zero = F.lit(0.0)
    return per_class.select(
        "y",
        *totals,
        F.coalesce(F.try_divide(found, predicted), zero).alias("precision"),
        F.coalesce(F.try_divide(found, support), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * found, support + predicted), zero).alias("f1"),
    )


def _weighted(name: str):
    share = F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support"))
    return share.alias(name)


def prf_weighted(preds: DataFrame) -> DataFrame:
    """Precision, recall and F1 averaged over classes by support."""
    return per_class_scores(preds).agg(*[_weighted(c) for c in ("precision", "recall", "f1")])


def ordinal_accuracy(preds: DataFrame, k: int = 4) -> DataFrame:
    """Mean of ``1 - |true - predicted| / k``."""
    miss = F.abs(F.col("ytrue") - F.col("ypred"))
    return preds.agg(F.avg(1 - miss / k).alias("ordinal_accuracy"))


def excluding_class(preds: DataFrame, cls: int = NO_BUS) -> DataFrame:
    """Rows whose true class is another one."""
    return preds.where(F.col("ytrue") != cls)


def report(preds: DataFrame, k: int = 4) -> DataFrame:
    """One row: accuracy, weighted scores and ordinal accuracy, from one pass."""
    rows = F.sum("support")
    return per_class_scores(preds, k).agg(
        F.try_divide(F.sum("hit"), rows).alias("accuracy"),
        *[_weighted(c) for c in ("precision", "recall", "f1")],
        F.try_divide(F.sum("closeness"), rows).alias("ordinal_accuracy"),
    )


def focal_loss(
    scored: DataFrame,
    weights: DataFrame,
    snapshot: Sequence[str],
    gamma: float = 2.0,
    log_probs: str = "log_probs",
) -> DataFrame:
    """Mean over snapshots of the mean of ``weight[y] * (1 - p)^gamma * (-ln p)``.

    ``log_probs`` holds the log probability of every class; ``weights`` one row per class.
    """
    chosen = F.get(F.col(log_probs), F.col("y"))
    weighted = adaptive_join(scored, weights.select("y", "weight"), ["y"], "inner")
    term = F.col("weight") * F.pow(1 - F.exp(chosen), F.lit(gamma)) * -chosen
    per_snapshot = weighted.groupBy(*snapshot).agg(F.avg(term).alias("_loss"))
    return per_snapshot.agg(F.avg("_loss").alias("focal_loss"))
