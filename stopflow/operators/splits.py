"""Train/validation/test membership that does not depend on how rows are partitioned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.operators.ordered import rank_in_group
from stopflow.operators.skew import adaptive_join
from stopflow.session import stored

HASH_STEPS = 10_000


def ordered_split(
    snapshots: DataFrame,
    order: Sequence[str],
    validation: float = 0.1,
    test: float = 0.2,
    seam_gap: int = 1,
    keep_unused: bool = False,
) -> DataFrame:
    """Add ``split`` by position: first train, then validation, then test.

    Part sizes are truncated to whole rows, the remainder trains. ``seam_gap`` rows at the
    start of every later part belong to no part (and are dropped unless ``keep_unused``).
    """
    ranked = rank_in_group(snapshots, [], order, "_pos")
    total = snapshots.agg(F.count(F.lit(1))).first()[0]
    n_test, n_val = int(total * test), int(total * validation)
    n_train = total - n_test - n_val
    at = F.col("_pos") - 1
    starts_val, starts_test = n_train, n_train + n_val
    split = (
        F.when(at < starts_val, "train")
        .when((at >= starts_val + seam_gap) & (at < starts_test), "validation")
        .when((at >= starts_test + seam_gap) & (at < starts_test + n_test), "test")
    )
    out = ranked.withColumn("split", split).drop("_pos")
    return out if keep_unused else out.where(F.col("split").isNotNull())


def hash_split(
    df: DataFrame,
    keys: Sequence[str],
    test: float = 0.2,
    validation: float = 0.12,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` from a hash of the key: a test share, then a validation share of the rest.

    All rows of a key fall into one part, whatever the partitioning or the number of runs.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    first = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % HASH_STEPS
    second = F.conv(F.substring(F.md5(text), 8, 7), 16, 10).cast("long") % HASH_STEPS
    split = (
        F.when(first < int(test * HASH_STEPS), "test")
        .when(second < int(validation * HASH_STEPS), "validation")
        .otherwise("train")
    )
    return df.withColumn("split", split)


# Ranges in which hashes are counted at once, and hashes few enough to be looked at one by one.
COUNT_RANGES, FEW_HASHES = 4_096, 20_000
_DIGITS = 13


def _smallest(hashes: DataFrame, k: int) -> str | None:
    """The k-th smallest of distinct hexadecimal hashes (column ``_h``), by refined counts.

    Each pass counts the hashes in equal ranges of the one that holds the k-th, until few are left.
    """
    if k <= 0:
        return None
    low, width = 0, 16**_DIGITS
    place = F.conv(F.substring("_h", 1, _DIGITS), 16, 10).cast("long").alias("_at")
    placed = hashes.select("_h", place)
    while True:
        inside = placed.where((F.col("_at") >= low) & (F.col("_at") < low + width))
        step = max(width // COUNT_RANGES, 1)
        counts = inside.groupBy(F.floor((F.col("_at") - low) / step).alias("r")).count().collect()
        for r in sorted(counts, key=lambda r: r["r"]):
            if r["count"] >= k:
                break
            k -= r["count"]
        low, width = low + r["r"] * step, step
        if r["count"] <= FEW_HASHES or width == 1:
            last = placed.where((F.col("_at") >= low) & (F.col("_at") < low + width))
            return sorted(h["_h"] for h in last.select("_h").collect())[k - 1]


def exact_split(
    df: DataFrame,
    keys: Sequence[str],
    test: float = 0.2,
    validation: float = 0.12,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: an exact share of the keys tests, an exact share of the rest validates.

    Shares are rounded up to whole keys. Keys stand in the order of a hash, so membership does not
    depend on partitioning or repetition; all rows of a key fall into one part.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text))
    hashes = stored(hashed.select("_h").distinct(), "hashes")
    n = hashes.count()
    n_test = math.ceil(n * test)
    n_validation = math.ceil((n - n_test) * validation)
    last = [_smallest(hashes, k) for k in (n_test, n_test + n_validation)]
    # No hash is below the empty string.
    to_test, to_validation = (F.col("_h") <= F.lit(v or "") for v in last)
    split = F.when(to_test, "test").when(to_validation, "validation").otherwise("train")
    return hashed.withColumn("split", split).drop("_h")


def stratified_fold(
    df: DataFrame, y: str, order: Sequence[str], n: int = 5, name: str = "is_test"
) -> DataFrame:
    """Mark the first of ``n`` unshuffled stratified folds.

    Classes stand in order of first appearance; a class that covers places S+1 .. S+size of
    that line gives the fold ``ceil((S+size)/n) - ceil(S/n)`` of its first rows.
    """
    # Only the per-class summary (one row per class) is windowed without a partition.
    classes = df.groupBy(y).agg(
        F.count(F.lit(1)).alias("_size"), F.min(F.struct(*order)).alias("_seen")
    )
    line = Window.partitionBy(F.lit(0)).orderBy("_seen")
    end = F.sum("_size").over(line)
    quota = F.ceil(end / n) - F.ceil((end - F.col("_size")) / n)
    quotas = classes.select(y, quota.alias("_quota"))
    ranked = adaptive_join(rank_in_group(df, [y], order, "_nth"), quotas, [y], null_safe=True)
    return ranked.withColumn(name, F.col("_nth") <= F.col("_quota")).drop("_nth", "_quota")


def best_epoch(
    history: DataFrame,
    loss: str = "validation_loss",
    order: str = "epoch",
    per: Sequence[str] = (),
) -> DataFrame:
    """Row with the lowest loss, the latest on ties; of the whole history or per run."""
    if not per:
        return history.orderBy(F.asc_nulls_last(loss), F.desc(order)).limit(1)
    w = Window.partitionBy(*per).orderBy(F.asc_nulls_last(loss), F.desc(order))
    return history.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")

