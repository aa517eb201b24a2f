"""Near-duplicate groups by bottom-k sketches of word shingles.

A document is the set of its distinct word shingles, as 63-bit hashes. One hash function gives
its sketch, the k smallest. Inverted lists of the retained values propose pairs, the bottom k of
the union of two sketches estimates their similarity, and the full sets decide.

Two sketches that must share ``o`` values share one among the ``k - o + 1`` rarest of either, so
a document enters only the lists of its rarest values, and values that nothing shares need no
list. For a set that fits its sketch ``o`` is exact; otherwise it lies ``DEVIATIONS`` standard
deviations below the expected overlap, so that a link is missed with probability near 1e-7.
Documents still in doubt after a first round with short sketches get long ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.components import stars
from stopflow.llm.text import chunks, mixed, text_bytes, token_table, word_hashes
from stopflow.session import BROADCAST_ROWS, setting, stored

SKETCH, LONG_SKETCH = 64, 512
DEVIATIONS = 5.5
# Least values of a node that its list entries carry, to tell whether a pair has met before.
EARLY = 8

_FACTOR = [mixed(np.array([i + 1], dtype=np.uint64))[0] | np.uint64(1) for i in range(64)]


def _shingle_sets(texts: list[bytes], words: int):
    """The sorted distinct shingle hashes of each text; fewer words make one shingle of all."""
    codes, table, starts = token_table(texts)
    hashes = word_hashes(table)[codes]
    joint = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        joint += hashes[i : i + len(joint)] * _FACTOR[i]
    joint = mixed(joint) >> np.uint64(1)
    for a, b in zip(starts[:-1], starts[1:] - 1, strict=True):
        if b - a >= words:
            yield np.unique(joint[a : b - words + 1]).view(np.int64)
        elif b > a:
            short = hashes[a:b] * np.array(_FACTOR[: b - a], dtype=np.uint64)
            one = short.sum(dtype=np.uint64) + np.uint64(b - a)
            yield (mixed(np.array([one])) >> np.uint64(1)).view(np.int64)
        else:
            yield np.empty(0, dtype=np.int64)


def sketches(docs: DataFrame, words: int = 5, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, set_id (hash of the whole set; NULL for none) and sketch per row."""

    def run(batches):
        for rest, texts in chunks(batches):
            sets = list(_shingle_sets(texts, words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rest["doc_id"], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]).cast(
                        pa.binary()
                    ),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    schema = "doc_id long, n_shingles long, set_id binary, sketch array<long>"
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, and its whole sorted shingle set."""

    def run(batches):
        for rest, texts in chunks(batches):
            sets = pa.array(list(_shingle_sets(texts, words)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rest["doc_id"], pa.int64()), sets], names=["node", "shingles"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "node long, shingles array<long>")


def _sampled_share(percent: int, k: int) -> float:
    """Share of k sampled values that a pair at the limit has in common, less the deviations."""
    ratio = percent / 100
    return max(ratio - DEVIATIONS * math.sqrt(ratio * (1 - ratio) / k), 0.0)


def inverted_lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """value, node, n_shingles, weight, need, rest, early: every node under its rarest shared values.

    ``weight`` sums the list lengths of the node's values and is high for the middle of a group;
    ``need`` is the overlap it needs with any partner, and ``rest`` counts the values from this
    one on, rarest first, which bounds the overlap of a pair whose first common value it is.
    ``early`` are the least of the values that the node is listed under, each with its ``rest``.
    """
    values = classes.select("node", F.explode("sketch").alias("value"))
    sizes = values.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    per_node = (
        values.join(sizes, "value")
        .groupBy("node")
        .agg(
            F.sort_array(F.collect_list(F.struct("f", "value"))).alias("list"),
            F.sum("f").alias("weight"),
        )
        .join(classes.select("node", "n_shingles"), "node")
    )
    # Where the larger set of a pair fits its sketch too, both sketches are the sets.
    whole = F.col("n_shingles") * 100 <= k * percent
    share = F.when(whole, percent / 100).otherwise(_sampled_share(percent, k))
    held = F.least("n_shingles", F.lit(k))
    need = F.greatest(F.ceil(held * share - 1e-9), F.lit(1))
    per_node = per_node.withColumn("need", need.cast("int")).where("size(list) >= need")
    rarest = F.slice("list", F.lit(1), F.size("list") - F.col("need") + 1)
    own = F.transform(
        rarest,
        lambda e, i: F.named_struct(F.lit("value"), e["value"], F.lit("rest"), F.size("list") - i),
    )
    early = F.slice(F.array_sort(own), 1, EARLY).alias("early")
    return per_node.select(
        "node", "n_shingles", "weight", "need", "list", early, F.posexplode(rarest).alias("at", "e")
    ).select(
        F.col("e.value").alias("value"),
        "node",
        "n_shingles",
        "weight",
        "need",
        (F.size("list") - F.col("at")).alias("rest"),
        "early",
    )


def _needed(percent: int, k: int):
    """The overlap of the sketches that a pair needs."""
    whole = F.greatest("n_a", "n_b") * 100 <= k * percent
    exact = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100.0 + percent) - 1e-9)
    return F.when(whole, exact).otherwise(F.greatest("need_a", "need_b"))


def _reachable(percent: int, k: int):
    """Whether the values left from a common one on can make up the overlap that a pair needs."""
    return F.least("rest_a", "rest_b") >= _needed(percent, k)


def _met_before(percent: int, k: int):
    """Whether the pair is reachable from a smaller common value among the least of both, too.

    There it is proposed as well, so that similar sets do not meet under all they share.
    """
    need = _needed(percent, k)

    def too(x, y):
        return (x["value"] == y["value"]) & (F.least(x["rest"], y["rest"]) >= need)

    return F.exists(
        "early_a",
        lambda x: (x["value"] < F.col("value")) & F.exists("early_b", lambda y: too(x, y)),
    )


def _comparable(percent: int):
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return small * 100 >= large * percent


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch shows enough common values."""
    x = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    y = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.array_intersect(F.array_intersect("sa", "sb"), F.col("u"))
    # A union below k values is the whole union.
    share = F.when(F.size("u") < k, percent / 100).otherwise(_sampled_share(percent, k))
    return (
        pairs.select("a", "b")
        .join(x, "a")
        .join(y, "b")
        .withColumn("u", union)
        .where(F.size(both) >= F.size("u") * share - 1e-9)
        .select("a", "b")
    )


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = stored(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    # Few nodes go to the texts, so that no text is shuffled.
    few = 2 * pairs.count() <= setting(pairs.sparkSession, BROADCAST_ROWS)
    nodes = F.broadcast(nodes) if few else nodes.distinct()
    sets = stored(full_sets(docs.join(nodes, "doc_id", "left_semi"), words), "sets")
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    both = F.size("sa").cast("long") + F.size("sb")
    near = (100 + percent) * common >= percent * both
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, k: int = SKETCH
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Texts with equal sets are one class, named after its smallest doc_id. First every class
    meets the heaviest class of its lists, which ties most of a large group together; then
    classes of one list that are still in different components are compared pairwise. Pairs
    inside a component need no test, so a group of copies costs no quadratic work, and no link
    that could join two components is left out.

    Empty and missing texts have no shingles and stay alone. A row without doc_id takes no part:
    its component is NULL and it is kept. Rows that share a doc_id are one document. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = stored(sketches(docs, words, k), "sketches")
    named = base.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = stored(
        named.groupBy("set_id").agg(
            F.min("doc_id").alias("node"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    lists = stored(inverted_lists(classes, percent, k).drop("early"), "lists")

    top = lists.groupBy("value").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n_shingles")).alias("h"),
        F.count("*").alias("size"),
    )
    first = (
        lists.join(top.where("size > 1"), "value")
        .select(
            F.col("node").alias("a"),
            (-F.col("h.minus")).alias("b"),
            F.col("n_shingles").alias("n_a"),
            F.col("h.n_shingles").alias("n_b"),
            F.col("h.weight").alias("w"),
        )
        .where((F.col("a") != F.col("b")) & _comparable(percent))
        .groupBy("a")
        .agg(F.max_by("b", F.struct("w", -F.col("b"))).alias("b"))
    )
    part = stars(verified(_estimated(first, classes, percent, k), docs, words, percent))

    labelled = stored(
        lists.join(part, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        ),
        "labelled",
    )
    mixed_lists = (
        labelled.groupBy("value")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo != hi")
        .select("value")
    )
    doubtful = stored(
        labelled.join(mixed_lists, "value", "left_semi").select("node", "component").distinct(),
        "doubtful",
    )
    again = docs.join(doubtful.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    longer = stored(
        sketches(again, words, LONG_SKETCH).withColumnRenamed("doc_id", "node"), "long_sketches"
    )
    long_lists = inverted_lists(longer, percent, LONG_SKETCH).join(doubtful, "node")
    long_lists = stored(long_lists.drop("weight"), "long_lists")
    left = long_lists.toDF("a", "value", "n_a", "need_a", "rest_a", "early_a", "ca")
    right = long_lists.toDF("b", "value", "n_b", "need_b", "rest_b", "early_b", "cb")
    crossing = (
        left.join(right.withColumnRenamed("value", "met"), F.col("value") == F.col("met"))
        .where((F.col("ca") < F.col("cb")) & _comparable(percent))
        .where(_reachable(percent, LONG_SKETCH) & ~_met_before(percent, LONG_SKETCH))
        .select("a", "b")
        .distinct()
    )
    crossing = _estimated(crossing, longer, percent, LONG_SKETCH)
    more = verified(crossing, docs, words, percent)
    # Rows that share an id are one document, whatever classes they are in.
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own_class = (
        named.join(repeated, "doc_id", "left_semi")
        .join(classes.select("set_id", "node"), "set_id")
        .select("doc_id", "node")
    )
    least = own_class.groupBy("doc_id").agg(F.min("node").alias("b"))
    same_id = own_class.join(least, "doc_id").select(F.col("node").alias("a"), "b")
    final = stars(part.toDF("a", "b").union(more).union(same_id))

    by_class = classes.join(final, "node", "left").select(
        "set_id", F.coalesce("component", "node").alias("component")
    )
    label = (
        named.select("doc_id", "set_id")
        .join(by_class, "set_id")
        .groupBy("doc_id")
        .agg(F.min("component").alias("component"))
    )
    own = F.coalesce("component", "doc_id")
    return base.join(label, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
