"""Joins and range splits that hold when a few keys own a large share of the rows.

Plain aggregates need none of this: Spark combines them before the shuffle. What is left are
joins on fact keys and ordered windows inside a group. Both start from the heavy groups, found
by counting keys. Where no group is heavy the plan is the ordinary one. The list only steers how
the work is spread: a group missed by the sample gives the same result on one task. It is a stored
table of any length; whether it is broadcast follows from the size of its files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.session import BROADCAST_ROWS, HOT_GROUP_ROWS, setting, stored

# Sampled rows per range that a heavy group is cut into.
SAMPLES_PER_BLOCK = 20
# Sampled rows expected of a group right at the limit; enough to make a miss negligible.
EXPECTED_SAMPLE = 1_000
SEED = 17

BLOCK = "_block"
_ROWS = "_group_rows"


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], null_safe: bool):
    """Join condition over (left column, right column) pairs."""
    tests = [
        left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs
    ]
    return reduce(lambda x, y: x & y, tests)


def heavy_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys (renamed ``_hot_<key>``) and sizes of groups too large for one task, or None."""
    spark = df.sparkSession
    limit = setting(spark, HOT_GROUP_ROWS)
    share = min(1.0, EXPECTED_SAMPLE / limit)
    rows = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, SEED)
    size = F.ceil(F.count(F.lit(1)) / share).alias(_ROWS)
    sizes = rows.groupBy(*keys).agg(size)
    heavy = sizes.where(F.col(_ROWS) > limit)
    found = stored(heavy.withColumnsRenamed({k: f"_hot_{k}" for k in keys}), "heavy")
    return None if found.isEmpty() else found


def _equi_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    cond = same(left, renamed, [(k, f"_right_{k}") for k in on], null_safe)
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in on])


def _salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    null_safe: bool,
    hot: DataFrame,
) -> DataFrame:
    """Join in which a heavy key's rows form a grid of cells, each a key of its own.

    ``hot`` has the key (``_hot_<key>``) and the cells ``_left`` and ``_right`` into which either
    side is dealt by a hash of the row. A left row goes to its part of every right part and the
    reverse, so each pair meets once and either side is read once. Where a left row is copied its
    key has right rows, so copies that meet none of them are dropped.
    """
    pairs = [(k, f"_hot_{k}") for k in on]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        found = df.join(hot, same(df, hot, pairs, True), "left")
        n_own, n_other = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        mine = F.pmod(F.xxhash64(*df.columns), n_own).cast("int")
        each = F.explode(F.sequence(F.lit(0), n_other.cast("int") - 1))
        copied = (n_other > 1).alias("_copied")
        return found.select(*df.columns, mine.alias(own), each.alias(other), copied)

    a = dealt(left, "_left", "_right")
    b = dealt(right, "_right", "_left").drop("_copied").withColumn("_met", F.lit(True))
    renamed = b.withColumnsRenamed({k: f"_right_{k}" for k in [*on, "_left", "_right"]})
    cond = same(a, renamed, [(k, f"_right_{k}") for k in on], null_safe)
    for c in ("_left", "_right"):
        cond = cond & (a[c] == renamed[f"_right_{c}"])
    joined = a.join(renamed, cond, how)
    if how == "left":
        joined = joined.where(~F.col("_copied") | F.col("_met"))
    names = [*on, "_left", "_right"]
    return joined.drop(*[f"_right_{k}" for k in names], "_left", "_right", "_copied", "_met")


def adaptive_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join to a lookup of unknown but usually small size, each side computed once.

    Adaptive execution takes the strategy from the sizes it sees: a small right side is
    broadcast, a skewed left partition is split.
    """
    return _equi_join(left, right, on, how, null_safe)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    right_rows: int | None = None,
) -> DataFrame:
    """Join a large left side to another table (inner, left, left_semi or left_anti).

    A right side known to be within the bound is broadcast, so the left is not shuffled at all.
    Otherwise the left rows of heavy keys are dealt to several parts, each of which meets a copy
    of those keys' right rows.
    """
    if right_rows is not None and right_rows <= setting(left.sparkSession, BROADCAST_ROWS):
        return _equi_join(left, F.broadcast(right), on, how, null_safe)
    hot = heavy_groups(left, on)
    if hot is None:
        return _equi_join(left, right, on, how, null_safe)
    limit = setting(left.sparkSession, HOT_GROUP_ROWS)
    parts = F.ceil(F.col(_ROWS) / limit).cast("int")
    hot = hot.select(*[f"_hot_{k}" for k in on], parts.alias("_left"), F.lit(1).alias("_right"))
    return _salted_join(left, right, on, how, null_safe, hot)


def fan_out_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    null_safe: bool = False,
    how: str = "left",
) -> DataFrame:
    """Left or inner join of two fact tables where either side may repeat a key at will.

    What a key costs is the product of its rows on both sides. A key whose product passes the
    limit is dealt on both sides, into cells below the limit.
    """
    if not null_safe:
        # A missing key matches nothing.
        right = right.dropna(subset=list(on))
    limit = setting(left.sparkSession, HOT_GROUP_ROWS)
    side = max(int(limit**0.5), 1)
    n_left = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l"))
    n_right = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r"))
    heavy = _equi_join(n_left, n_right, on, "inner", True).where(F.col("_l") * F.col("_r") > limit)
    parts = [F.ceil(F.col(n) / side).cast("int").alias(c) for n, c in (("_l", "_left"), ("_r", "_right"))]
    hot = stored(heavy.select(*[F.col(k).alias(f"_hot_{k}") for k in on], *parts), "products")
    if hot.isEmpty():
        return _equi_join(left, right, on, how, null_safe)
    return _salted_join(left, right, on, how, null_safe, hot)


def _splits_at_or_below(splits: Column, position: Column) -> Column:
    """Number of sorted split points not above the position, by bisection."""
    rounds = F.ceil(F.log2(F.size(splits) + 1)).cast("int")
    start = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        passed = F.get(splits, mid) <= position
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & passed, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~passed, mid).otherwise(acc["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), rounds), start, halve)["lo"]


def tag_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Cut heavy groups into consecutive ranges of their order.

    Adds ``_block``: 0, 1, 2 … inside a heavy group, NULL elsewhere. Where no group is heavy,
    or the column is there already, the frame comes back unchanged. ``order`` must be total.
    The split points are data, so they are written out before use: every later
    evaluation of the plan, including a retry, sees the same ones.
    """
    if BLOCK in df.columns:
        return df
    hot = heavy_groups(df, keys)
    if hot is None:
        return df
    limit = setting(df.sparkSession, HOT_GROUP_ROWS)
    pairs = [(k, f"_hot_{k}") for k in keys]
    cond = same(df, hot, pairs, True) if keys else F.lit(True)
    blocks = F.ceil(F.col(_ROWS) / limit)
    share = F.least(F.lit(1.0), blocks * SAMPLES_PER_BLOCK / F.col(_ROWS))
    bucket = F.pmod(F.xxhash64(*order), F.lit(1_000_000_007)) / 1_000_000_007.0
    sample = (
        df.select(*keys, *[c for c in order if c not in keys])
        .join(hot, cond)
        .where(bucket < share)
    )
    every = F.size("_sample") / F.col("_blocks")
    cuts = F.when(
        F.col("_blocks") > 1,
        F.transform(
            F.sequence(F.lit(1), F.col("_blocks").cast("int") - 1),
            lambda i: F.get(F.col("_sample"), F.floor(i * every).cast("int")),
        ),
    )
    splits = stored(
        sample.groupBy(*[f"_hot_{k}" for k in keys])
        .agg(
            F.array_sort(F.collect_set(F.struct(*order))).alias("_sample"),
            F.max(blocks).alias("_blocks"),
        )
        .select(
            *[f"_hot_{k}" for k in keys],
            F.array_distinct(F.filter(cuts, lambda s: s.isNotNull())).alias("_splits"),
        ),
        "splits",
    )
    cond = same(df, splits, pairs, True) if keys else F.lit(True)
    block = F.when(
        F.col("_splits").isNotNull(), _splits_at_or_below(F.col("_splits"), F.struct(*order))
    )
    tagged = df.join(splits, cond, "left").withColumn(BLOCK, block)
    return tagged.drop("_splits", *[f"_hot_{k}" for k in keys])
