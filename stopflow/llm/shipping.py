"""Prepares a session: this library's code on the executors, and small Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
# Rows that travel to Python together. Texts and sets are long: Spark's 10,000 rows of them
# would stand in memory several times.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Tasks import the operators' modules by name; where the cluster was not started with the
    package, its source travels from the driver with the session's files.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    # The driver's own upload copy; executors fetch it through Spark.
    target = Path(tempfile.mkdtemp(prefix="stopflow-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
