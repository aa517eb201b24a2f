"""Lead, fill and rank inside groups of any size.

Ordinary groups use a plain window. A heavy group is cut into consecutive blocks
(``skew.tag_blocks``); each block is windowed on its own task and what crosses a block border
travels in a stored carry table with one row per group and block.

Every function looks for heavy groups itself. A caller that chains several of them tags once
(``tag_blocks`` on the same keys, or on a subset of them) and passes ``tagged=True``; the block
column then stays in the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.operators.skew import BLOCK, same, tag_blocks
from stopflow.session import stored


def _window(df: DataFrame, keys: Sequence[str], order: Sequence[str]):
    blocks = [BLOCK] if BLOCK in df.columns else []
    return Window.partitionBy(*keys, *blocks).orderBy(*order)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a per-block carry table back on (keys, block); its stored size settles how."""
    renamed = stored(carry, "carry").withColumnsRenamed({k: f"_c_{k}" for k in [*keys, BLOCK]})
    cond = same(df, renamed, [(k, f"_c_{k}") for k in [*keys, BLOCK]], True)
    return df.join(renamed, cond, "left").drop(
        *[f"_c_{k}" for k in [*keys, BLOCK]]
    )


def _per_block(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return (
        df.where(F.col(BLOCK).isNotNull())
        .groupBy(*keys, BLOCK)
        .agg(*[a.alias(name) for name, a in aggs.items()])
    )


def lead_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Mapping[str, str],
    tagged: bool = False,
) -> DataFrame:
    """Add, for each ``new: source`` pair, the source value of the next row of the group.

    A column ``has_next`` tells a NULL value from the end of the group.
    """
    source = df if tagged else tag_blocks(df, keys, order)
    following = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    out = source.withColumn("_next", F.lead(following).over(_window(source, keys, order)))
    if BLOCK in source.columns:
        heads = _per_block(source, keys, _head=F.min_by(following, F.struct(*order)))
        across = Window.partitionBy(*keys).orderBy(BLOCK)
        carry = heads.select(*keys, BLOCK, F.lead("_head").over(across).alias("_carry"))
        out = _attach(out, carry, keys).withColumn("_next", F.coalesce("_next", "_carry"))
        out = out.drop("_carry")
    out = out.withColumns({new: F.col("_next")[new] for new in cols})
    out = out.withColumn("has_next", F.col("_next").isNotNull()).drop("_next")
    return out if BLOCK in df.columns else out.drop(BLOCK)


def _fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    forward: bool,
    backward: bool,
    tagged: bool,
) -> DataFrame:
    source = df if tagged else tag_blocks(df, keys, order)
    w = _window(source, keys, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Nearest later value: the same running frame over the reversed order. A frame that
    # ends at the group's last row would rescan the rest of the group for every row.
    reverse = _window(source, keys, [F.col(c).desc() for c in order])
    to_come = reverse.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps: dict[str, list[Column]] = {c: [] for c in cols}
    temp: dict[str, Column] = {}
    for c in cols:
        if forward:
            temp[f"_past_{c}"] = F.last(c, ignorenulls=True).over(so_far)
            steps[c].append(F.col(f"_past_{c}"))
        elif backward:
            temp[f"_next_{c}"] = F.last(c, ignorenulls=True).over(to_come)
            steps[c].append(F.col(f"_next_{c}"))
        if forward and backward:
            # Only leading gaps are left, so the value is the first one of the group.
            temp[f"_first_{c}"] = F.first(c, ignorenulls=True).over(whole)
    out = source.withColumns(temp)
    if BLOCK in source.columns:
        position = F.struct(*order)
        aggs = {}
        for c in cols:
            at = F.when(F.col(c).isNotNull(), position)
            aggs[f"_tail_{c}"] = F.max_by(F.col(c), at)
            aggs[f"_head_{c}"] = F.min_by(F.col(c), at)
        across = Window.partitionBy(*keys).orderBy(BLOCK)
        back = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc())
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        later = back.rowsBetween(Window.unboundedPreceding, -1)
        carried = []
        for c in cols:
            if forward:
                carried.append(
                    F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}")
                )
                steps[c].append(F.col(f"_before_{c}"))
            if forward and backward:
                steps[c].append(F.col(f"_first_{c}"))
            if backward:
                carried.append(
                    F.last(f"_head_{c}", ignorenulls=True).over(later).alias(f"_after_{c}")
                )
                steps[c].append(F.col(f"_after_{c}"))
        carry = _per_block(source, keys, **aggs).select(*keys, BLOCK, *carried)
        out = _attach(out, carry, keys)
    elif forward and backward:
        for c in cols:
            steps[c].append(F.col(f"_first_{c}"))
    out = out.withColumns({c: F.coalesce(*steps[c]) for c in cols})
    return out.select(*df.columns)


def fill_forward(df, keys, order, cols, tagged=False) -> DataFrame:
    """Carry the last non-null value of each column down its group."""
    return _fill(df, keys, order, cols, forward=True, backward=False, tagged=tagged)


def fill_backward(df, keys, order, cols, tagged=False) -> DataFrame:
    """Carry the next non-null value of each column up its group."""
    return _fill(df, keys, order, cols, forward=False, backward=True, tagged=tagged)


def fill_both(df, keys, order, cols, tagged=False) -> DataFrame:
    """Forward fill, then fill what is left at the start of the group from below."""
    return _fill(df, keys, order, cols, forward=True, backward=True, tagged=tagged)


def any_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flag: Column,
    name: str,
    tagged: bool = False,
) -> DataFrame:
    """Add whether ``flag`` holds on any row of the group (a missing flag does not)."""
    source = df if tagged else tag_blocks(df, keys, order)
    source = source.withColumn(name, F.coalesce(flag, F.lit(False)))
    blocks = [BLOCK] if BLOCK in source.columns else []
    out = source.withColumn(name, F.max(name).over(Window.partitionBy(*keys, *blocks)))
    if blocks:
        whole = Window.partitionBy(*keys)
        carry = _per_block(source, keys, _any=F.max(name)).select(
            *keys, BLOCK, F.max("_any").over(whole).alias("_any")
        )
        out = _attach(out, carry, keys)
        out = out.withColumn(name, F.coalesce("_any", name)).drop("_any")
    return out if BLOCK in df.columns else out.drop(BLOCK)


def rank_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    tagged: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in its group (``keys`` may be empty)."""
    source = df if tagged else tag_blocks(df, keys, order)
    local = F.row_number().over(_window(source, keys, order)).cast("long")
    out = source.withColumn(name, local)
    if BLOCK in source.columns:
        across = Window.partitionBy(*keys).orderBy(BLOCK)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carry = _per_block(source, keys, _n=F.count(F.lit(1))).select(
            *keys, BLOCK, F.sum("_n").over(before).alias("_offset")
        )
        out = _attach(out, carry, keys)
        out = out.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0))).drop("_offset")
    return out if BLOCK in df.columns else out.drop(BLOCK)
