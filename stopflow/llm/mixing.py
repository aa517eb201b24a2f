"""Mixing sources to target weights: random order, prefix sums and one cut per source.

Every document gets a hash key from its id. In key order a source is taken whole as often as its
target allows, and once more up to the exact word at which the target is met.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
# Hex digits of the key that name its range; a source's keys fall into 16 ** 3 even ranges.
RANGE_DIGITS = 3


def word_count(text: str = "text") -> Column:
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return words.cast("long")


def mix_key(doc_id: str = "doc_id") -> Column:
    """A random-looking key that depends on the id alone; a missing id has a key too."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.substring(F.md5(F.concat(F.lit("mix:"), name)), 1, 16)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): ``share`` of all words, dealt by weight.

    Sources in code point order, NULL last, take the weights in turn. No target passes
    ``epochs`` times the source; what is over goes to the others by weight. Filled from the
    source that is full first, this is one level for all that are not full. The window runs
    over one row per source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("turn", turn).withColumn("weight", weight.cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * epochs)
    fullest = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "place": F.row_number().over(fullest),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "budget": F.sum("source_size").over(everything).cast("double") * share,
            "weight_all": F.sum("weight").over(everything),
        }
    )
    level = (F.col("budget") - F.col("cap_before").cast("double")) / (
        F.col("weight_all") - F.col("weight_before")
    ).cast("double")
    rows = rows.withColumn("level", level)
    full = F.col("level") * F.col("weight") > F.col("cap")
    open_level = F.min(F.when(~full, F.struct("place", "level"))).over(everything)["level"]
    target = F.when(full, F.col("cap").cast("double")).otherwise(open_level * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


@dataclass
class Mix:
    """``counted``: doc_id, source, key, size by row. ``cuts``: what each source takes."""

    counted: DataFrame
    cuts: DataFrame


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> Mix:
    """Where to cut each source of ``docs`` (doc_id, source, text).

    A source's keys lie in even ranges; sums by range find the range of the cut, and only rows
    of that range are ordered. Rows that repeat an id share a key and are cut together. Missing
    texts have no words, a missing source is a source, and an empty table gives no cuts.
    """
    counted = stored(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            mix_key().alias("key"),
            word_count().alias("size"),
        ),
        "mix-sizes",
    )
    ranges = stored(
        counted.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(
            F.sum("size").alias("words")
        ),
        "mix-ranges",
    )
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    wanted = targets(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    wanted = wanted.withColumn("full", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "rest", F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    )
    wanted = stored(wanted, "mix-targets")

    by_source = Window.partitionBy("source").orderBy("range")
    placed = ranges.withColumn("before", F.sum("words").over(by_source) - F.col("words"))
    target_of = wanted.select(F.col("source").alias("s"), "rest")
    hit = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    cut_ranges = placed.join(target_of, F.col("source").eqNullSafe(F.col("s"))).where(hit)
    cut_ranges = cut_ranges.select(
        "s", F.col("range").alias("r"), (F.col("rest") - F.col("before")).alias("into")
    )
    ranged = counted.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    near = ranged.join(
        cut_ranges,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")),
    )
    units = near.groupBy("source", "key", "into").agg(F.sum("size").alias("unit"))
    upto = F.sum("unit").over(Window.partitionBy("source").orderBy("key"))
    units = units.withColumn("before", upto - F.col("unit"))
    cut = units.where("before <= into AND into < before + unit").select(
        F.col("source").alias("s"),
        F.col("key").alias("cut_key"),
        (F.col("into") - F.col("before")).alias("cut_words"),
        "unit",
    )
    cuts = wanted.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return Mix(counted, stored(cuts, "mix-cuts"))


def with_cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """Join the cut of each row's source (columns of ``cuts`` but its source)."""
    cuts = mix.cuts.withColumnRenamed("source", "_source")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def taken_words() -> Column:
    """Words the mix takes of a row with ``key``, ``size`` and its source's cut."""
    part = F.floor(F.col("cut_words") * F.col("size") / F.col("unit"))
    once_more = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(
        F.col("key") == F.col("cut_key"), part
    )
    return (F.col("full") * F.col("size") + F.coalesce(once_more, F.lit(0))).cast("long")


def taken_copies() -> Column:
    """Whole copies the mix takes of a row: the row at the cut counts if half of it is in."""
    half_in = F.col("cut_words") * 2 >= F.col("unit")
    more = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & half_in)
    return (F.col("full") + F.coalesce(more.cast("long"), F.lit(0))).cast("int")


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it whole."""
    mix = plan(docs, weights, share, epochs)
    names = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    keyed = docs.select(F.struct("*").alias("_row")).select(
        "_row", F.col("_row.source").cast("string").alias("source")
    )
    keyed = keyed.withColumn("key", mix_key("_row.doc_id"))
    copies = with_cuts(keyed, mix).withColumn("copies", taken_copies())
    return copies.where("copies > 0").select(
        *names, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")
    ).drop("_copy")
