"""Baseline classifiers on ``snapshot_class_mean`` rows: a forest of Spark ML, boosted trees and a
perceptron of this library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.operators import boosting, perceptron
from stopflow.operators.snapshots import FEATURES

CLASSES = 4
# The deepest trees Spark ML grows.
FULL_DEPTH = 30


def random_forest(trees: int = 500, seed: int = 42, depth: int = FULL_DEPTH) -> Estimator:
    return RandomForestClassifier(
        labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed
    )


def as_examples(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Numeric label and features, missing features as 0."""
    return rows.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features},
            "y": F.col("y").cast("double"),
        }
    )


def train(
    estimator: Estimator, rows: DataFrame, features: Sequence[str] = FEATURES
) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, estimator]).fit(as_examples(rows, features))


def train_perceptron(
    rows: DataFrame, settings: perceptron.Settings | None = None, features: Sequence[str] = FEATURES
) -> perceptron.Model:
    return perceptron.fit(as_examples(rows, features), features, settings)


def train_boosted_trees(
    rows: DataFrame, settings: boosting.Settings | None = None, features: Sequence[str] = FEATURES
) -> boosting.Model:
    return boosting.fit(as_examples(rows, features), features, settings)


def batch_score(
    model: PipelineModel | perceptron.Model | boosting.Model, rows: DataFrame, *keep: str
) -> DataFrame:
    """Predicted class next to the true one."""
    scored = model.transform(as_examples(rows))
    return scored.select(
        *keep,
        F.col("y").cast("int").alias("ytrue"),
        F.col("prediction").cast("int").alias("ypred"),
    )
