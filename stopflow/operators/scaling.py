"""Min-max scaling and label encoding fitted on the whole data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.operators.ordered import rank_in_group
from stopflow.operators.skew import keyed_join
from stopflow.session import HOT_GROUP_ROWS, setting, stored

SCALED_COLUMNS = (
    "precipitation_intensity",
    "temperature",
    "humidity",
    "actual_hdwy",
    "delay",
    "displacement",
    "median_income_last12months",
    "average_speed",
)


def fit_minmax(df: DataFrame, cols: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    """One row with ``<col>_min`` and ``<col>_max``; NULLs are ignored. Can be saved."""
    return df.agg(
        *[F.min(c).cast("double").alias(f"{c}_min") for c in cols],
        *[F.max(c).cast("double").alias(f"{c}_max") for c in cols],
    )


def apply_minmax(
    df: DataFrame, bounds: DataFrame, cols: Sequence[str] = SCALED_COLUMNS
) -> DataFrame:
    """``(x - min) / (max - min)`` per column, a constant column becoming ``x - min``.

    The bounds are a single row; they enter the plan as literals, so scaling is a projection.
    Values outside the fitted range leave [0, 1].
    """
    fitted = bounds.first()

    def scaled(c: str):
        lo, hi = fitted[f"{c}_min"], fitted[f"{c}_max"]
        if lo is None:
            return F.lit(None).cast("double")
        return (F.col(c) - lo) / ((hi - lo) or 1.0)

    return df.withColumns({c: scaled(c) for c in cols})


def save_bounds(bounds: DataFrame, path: str) -> None:
    """Keep fitted bounds, one row, for use on other tables."""
    bounds.coalesce(1).write.mode("overwrite").parquet(path)


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def minmax(df: DataFrame, cols: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    """Fit and apply on the same rows."""
    return apply_minmax(df, fit_minmax(df, cols), cols)


def label_codes(values: DataFrame, col: str, n_values: int) -> DataFrame:
    """Distinct values of a column, ``n_values`` of them, with their 0-based natural rank."""
    known = values.select(col).where(F.col(col).isNotNull()).distinct()
    few = n_values <= setting(values.sparkSession, HOT_GROUP_ROWS)
    ranked = rank_in_group(known, [], [col], "_rank", tagged=few)
    return ranked.select(col, (F.col("_rank") - 1).cast("int").alias(f"{col}_cat"))


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_cat`` for every column.

    The distinct combinations of the columns are stored once. Their values are counted in one
    job, which settles how to rank and join them, and ranked per column.
    """
    seen = stored(df.select(*cols).distinct(), "labels")
    sizes = seen.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    for c in cols:
        codes = label_codes(seen, c, sizes[c])
        df = keyed_join(df, codes, [c], "left", right_rows=sizes[c])
    return df
