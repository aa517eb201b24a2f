"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in their order. Shards post their vectors, with the
place a pivot has among a vector's nearest, in one inverted file per pivot. A query sums over the
files of its own nearest pivots how much less its order differs from a vector's than if
the vector did not list them: the footrule distance. The nearest by footrule are ranked again by their
inner products on the original vectors.

Pivots and the share of rows to rank again are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.llm.mtree import matrix, valid
from stopflow.llm.packing import from_file, to_file
from stopflow.session import stored

# Rows the fit sees, pivots, places a vector lists and places a query asks.
SAMPLE, PIVOTS, LISTED, ASKED = 4_096, 256, 64, 32
# Pivots closer than this cosine are one; sample queries of the fit; share of their neighbours
# that the ranked rows have to hold, and the factor by which more are ranked.
SAME, TRIALS, HELD, MARGIN = 0.95, 256, 0.97, 1.25
# Rows of a shard, and queries that meet it together.
SHARD_ROWS, ASK_ROWS = 8_192, 2_048


@dataclass(frozen=True)
class Fit:
    """Pivots in the lifted space, the norm that all vectors are scaled by, and the share ranked."""

    pivots: np.ndarray
    top: float
    share: float
    rows: int
    width: int


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of vectors whose squares may over- or underflow."""
    big = np.abs(x).max(axis=1, initial=0.0)
    safe = np.where(big > 0, big, 1.0)
    return safe * np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows scaled by the greatest norm, and the component that brings each to norm one.

    Among them the nearest to a query without that component is the one of largest product.
    """
    scaled = x / top
    rest = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
    return np.hstack([scaled, rest[:, None]])


def asking(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / norms(q)[:, None], np.zeros((len(q), 1))])


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """Rows ended by zeros."""
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def orders(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the earlier pivot."""
    near = -(x @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :places]


def gains(asked: int, listed: int) -> np.ndarray:
    """By how much a pivot at one place of a query and another of a vector lowers the footrule
    distance below that of a vector that does not list the pivot."""
    j, place = np.arange(asked)[:, None], np.arange(listed)[None, :]
    return (np.abs(j - listed) - np.abs(j - place)).astype(np.int32)


def post(listed: np.ndarray, pivots: int) -> dict[str, np.ndarray]:
    """Inverted files, one after another: the rows that list a pivot and the place it has there."""
    n, places = listed.shape
    by_pivot = np.argsort(listed.reshape(-1), kind="stable")
    sizes = np.bincount(listed.reshape(-1), minlength=pivots)
    return {
        "begin": np.concatenate([[0], np.cumsum(sizes)]),
        "row": by_pivot // places,
        "place": by_pivot % places,
    }


def footrule(files: dict[str, np.ndarray], n: int, order: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Summed gains of all rows for a query's order of pivots; the largest are the nearest."""
    total = np.zeros(n, dtype=np.int32)
    begin, row, place = files["begin"], files["row"], files["place"]
    for j, p in enumerate(order.tolist()):
        span = slice(begin[p], begin[p + 1])
        total[row[span]] += gain[j][place[span]]
    return total


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed alike for equal rows wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((x * q).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """The first rows of which none lies close to one before."""
    taken: list[int] = []
    for i, v in enumerate(x):
        if len(taken) == most:
            break
        if not taken or (x[taken] @ v).max() < SAME:
            taken.append(i)
    return x[taken]


def fitted(sample: np.ndarray, top: float, rows: int, k: int) -> Fit:
    """Pivots out of the sample, and the share that holds the sample's own nearest neighbours.

    In the whole table neighbours are nearer than in the sample, so the share errs upwards.
    """
    x = lifted(sample, top)
    pivots = spread(x, PIVOTS)
    n, width = sample.shape
    if n < 2:
        return Fit(pivots, top, 1.0, rows, width)
    listed = orders(x, pivots, LISTED)
    files = post(listed, len(pivots))
    trial = sample[:TRIALS]
    asked = orders(asking(trial), pivots, ASKED)
    gain = gains(asked.shape[1], listed.shape[1])
    deep = []
    for i, q in enumerate(trial):
        others = np.delete(np.arange(n), i)
        total = footrule(files, n, asked[i], gain)[others]
        nearest = best(products(sample[others], q), others, k)
        # Rows of an equal distance are ranked all or none.
        deep.append((total[None, :] >= total[nearest][:, None]).sum(axis=1))
    share = np.quantile(np.concatenate(deep), HELD) / (n - 1)
    return Fit(pivots, top, float(min(1.0, MARGIN * share)), rows, width)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec of the rows that take part, one row per id."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    some = F.exists("vec", lambda x: x != 0)
    return (
        rows.where(F.col("vec_id").isNotNull() & valid(F.col("vec")) & some)
        .groupBy("vec_id")
        .agg(F.min("vec").alias("vec"))
    )


def fit(rows: DataFrame, k: int) -> Fit | None:
    """Fit to the rows with the smallest hashes of their ids; None where there is no row."""
    big = F.array_max(F.transform("vec", F.abs))
    norm = big * F.sqrt(
        F.aggregate(F.transform("vec", lambda x: x / big), F.lit(0.0), lambda s, x: s + x * x)
    )
    total = rows.agg(
        F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("vec")).alias("width")
    ).first()
    if not total["n"]:
        return None
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample = widened(matrix(first["vec"]), total["width"])
    return fitted(sample, total["top"], total["n"], k)


def write_index(rows: DataFrame, fit: Fit) -> DataFrame:
    """Shards (shard, file): vectors by id, and the inverted files of their pivots."""
    shards = -(-fit.rows // SHARD_ROWS)

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        x = widened(matrix(table["vec"]), fit.width)[by_id]
        listed = orders(lifted(x, fit.top), fit.pivots, LISTED)
        files = post(listed, len(fit.pivots))
        arrays = {
            "ids": ids[by_id],
            "vectors": x.reshape(-1),
            "begin": files["begin"],
            "row": files["row"].astype(np.uint32),
            "place": files["place"].astype(np.uint16),
        }
        return pa.table({"shard": table["shard"][:1], "file": pa.array([to_file(arrays)], pa.binary())})

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    dealt = rows.withColumn("shard", shard).groupBy("shard")
    return stored(dealt.applyInArrow(build, "shard int, file binary"), "permutations")


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(index: DataFrame, asks: DataFrame, fit: Fit, k: int) -> DataFrame:
    """query_id, vec_id and score: the k best of every shard for each row of ``asks``.

    Queries meet a shard in blocks, so neither a shard's queries nor a query's rows stand in one task.
    """
    shards = -(-fit.rows // SHARD_ROWS)
    parts = -(-asks.count() // ASK_ROWS) or 1

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {n: [] for n in _FOUND.names}
        for blob in left["file"].to_pylist():
            files = from_file(blob)
            ids, x = files["ids"], files["vectors"].reshape(-1, fit.width)
            files = {n: files[n].astype(np.intp) for n in ("begin", "row", "place")}
            some = min(len(ids), max(int(np.ceil(fit.share * len(ids))), 2 * k))
            q_ids = right["vec_id"].to_numpy()
            q = widened(matrix(right["vec"]), fit.width)
            asked = orders(asking(q), fit.pivots, ASKED)
            gain = gains(asked.shape[1], min(LISTED, len(fit.pivots)))
            for i, own in enumerate(q_ids):
                total = footrule(files, len(ids), asked[i], gain)
                near = np.argpartition(-total, some - 1)[:some]
                near = np.sort(near[ids[near] != own])
                score = products(x[near], q[i])
                top = best(score, ids[near], k)
                out["query_id"].append(np.full(len(top), own))
                out["vec_id"].append(ids[near[top]])
                out["score"].append(score[top])
        return pa.table(
            {f.name: pa.array(np.concatenate(out[f.name] or [[]]), f.type) for f in _FOUND}
        )

    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    blocks = asks.withColumn("part", part).withColumn("shard", every)
    files = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["shard", "part"]
    return (
        files.groupBy(*key)
        .cogroup(blocks.groupBy(*key))
        .applyInArrow(look, "query_id long, vec_id long, score double")
    )


def nearest(vectors: DataFrame, asks: Column, k: int) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k largest inner products found.

    Queries are the rows of ``vectors`` (vec_id, embedding) that fulfil ``asks``, a condition on vec_id; candidates
    are all rows but the query's own. Fewer come back where there are fewer candidates. Ties go to
    the smaller vec_id. Rows without id, and vectors that are missing, empty, zero or hold missing
    or non-finite components take no part. Shorter vectors count as ended by zeros. Of several
    vectors of one id the least counts, so repeated rows are one. A product that overflows is
    infinite, or the least if it is no number. Other columns are ignored.
    """
    rows = stored(usable(vectors), "vectors")
    model = fit(rows, k)
    if model is None:
        found = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"))
    else:
        found = search(write_index(rows, model), rows.where(asks), model, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, asks: Column, k: int) -> float:
    """Share of the true k nearest of the queries that ``found`` holds.

    Every query is compared with all rows, in blocks.
    """
    rows = stored(usable(vectors), "vectors")
    total = rows.count()
    blocks = -(-total // SHARD_ROWS) or 1
    parts = -(-rows.where(asks).count() // ASK_ROWS) or 1

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {n: [] for n in _FOUND.names}
        if left.num_rows and right.num_rows:
            ids, x, q = left["vec_id"].to_numpy(), matrix(left["vec"]), matrix(right["vec"])
            width = max(x.shape[1], q.shape[1])
            x, q = widened(x, width), widened(q, width)
            for own, v in zip(right["vec_id"].to_numpy(), q, strict=True):
                other = ids != own
                score = products(x[other], v)
                top = best(score, ids[other], k)
                out["query_id"].append(np.full(len(top), own))
                out["vec_id"].append(ids[other][top])
                out["score"].append(score[top])
        return pa.table(
            {f.name: pa.array(np.concatenate(out[f.name] or [[]]), f.type) for f in _FOUND}
        )

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.withColumn(own, mine).withColumn(other, each)

    true = (
        dealt(rows, "block", blocks, "part", parts)
        .groupBy("block", "part")
        .cogroup(dealt(rows.where(asks), "part", parts, "block", blocks).groupBy("block", "part"))
        .applyInArrow(compare, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = true.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return held.count() / max(true.count(), 1)
