"""Score a prediction set the way the published results were."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.operators.metrics import NO_BUS, excluding_class, report


def dynamic_report(preds: DataFrame) -> DataFrame:
    """Four classes."""
    return report(preds, k=4)


def static_report(preds: DataFrame) -> DataFrame:
    """Five classes: weighted scores over all rows, the rest without the no-bus class."""
    whole = report(preds, k=5).select(
        F.lit("all").alias("rows"), "accuracy", "precision", "recall", "f1", "ordinal_accuracy"
    )
    served = report(excluding_class(preds, NO_BUS), k=5).select(
        F.lit("served").alias("rows"),
        "accuracy",
        "precision",
        "recall",
        "f1",
        "ordinal_accuracy",
    )
    return whole.unionByName(served)
