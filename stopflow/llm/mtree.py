"""Exact top-k inner products by best-first search of M-trees.

Vectors become integers and get one more component that makes their norms equal, so that the
largest inner product is the smallest distance and the triangle inequality holds. Rows are dealt
to shards around pivots; each shard is an M-tree of pages with a routing object, a covering
radius and the distance to the parent page. A query first searches the shard of its own pivot and
takes the score it has to beat to all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopflow.llm.packing import from_file, to_file
from stopflow.session import stored

SCALE = 256
# Rows of a shard, pivots at most, entries of a page, and pages of an inner page.
SHARD_ROWS, MAX_PIVOTS, PAGE, FANOUT = 4_000, 1_024, 128, 8
# Relative slack of bounds, far above rounding and far below one step of a score.
SLACK = 1e-9


def valid(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the component that brings every squared norm to ``top``."""
    rest = np.maximum(top - (x * x).sum(axis=1), 0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _halves(x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Pages of at most ``PAGE`` rows: split between two far rows until they fit."""
    if len(own) <= PAGE:
        return [own]
    far = own[distances(x[own[:1]], x[own])[0].argmax()]
    a = distances(x[[far]], x[own])[0]
    b = distances(x[[own[a.argmax()]]], x[own])[0]
    order = np.argsort(a - b, kind="stable")
    cut = max(len(own) // 2 // PAGE, 1) * PAGE if len(own) > 2 * PAGE else len(own) // 2
    return _halves(x, own[order[:cut]]) + _halves(x, own[order[cut:]])


def _medoid(x: np.ndarray, own: np.ndarray) -> int:
    return int(own[distances(x[own].mean(axis=0)[None], x[own])[0].argmin()])


def build(ids: np.ndarray, ints: np.ndarray, top: float) -> bytes:
    """The M-tree file of a shard: entries in page order and, level by level, the pages."""
    x = lifted(ints, top)
    pages = _halves(x, np.arange(len(ids)))
    order = np.concatenate(pages)
    route = [_medoid(x, p) for p in pages]
    to_page = np.concatenate([distances(x[[r]], x[p])[0] for r, p in zip(route, pages, strict=True)])
    sizes = np.array([len(p) for p in pages])
    first = np.cumsum(sizes) - sizes
    nodes = {
        "route": list(route),
        "radius": [to_page[f : f + n].max() for f, n in zip(first, sizes, strict=True)],
        "begin": first.tolist(),
        "end": (first + sizes).tolist(),
        "members": list(pages),
    }
    parent_distance = np.zeros(len(pages))
    level_at, levels = 0, [0, len(pages)]
    while levels[-1] - level_at > FANOUT:
        upper = []
        for at in range(level_at, levels[-1], FANOUT):
            children = list(range(at, min(at + FANOUT, levels[-1])))
            members = np.concatenate([nodes["members"][c] for c in children])
            r = _medoid(x, members)
            d = distances(x[[r]], x[[nodes["route"][c] for c in children]])[0]
            parent_distance[children] = d
            upper.append((r, distances(x[[r]], x[members])[0].max(), children, members))
        level_at = levels[-1]
        for r, radius, children, members in upper:
            nodes["route"].append(r)
            nodes["radius"].append(radius)
            nodes["begin"].append(children[0])
            nodes["end"].append(children[-1] + 1)
            nodes["members"].append(members)
        parent_distance = np.append(parent_distance, np.zeros(len(upper)))
        levels.append(len(nodes["route"]))
    return to_file(
        {
            "ids": ids[order],
            "ints": ints[order].reshape(-1),
            "to_page": to_page,
            "route": ints[nodes["route"]].reshape(-1),
            "radius": np.array(nodes["radius"]),
            "begin": np.array(nodes["begin"], dtype=np.int64),
            "end": np.array(nodes["end"], dtype=np.int64),
            "to_parent": parent_distance,
            "shape": np.array([ints.shape[1], len(pages), level_at], dtype=np.int64),
            "top": np.array([top]),
        }
    )


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors held as doubles, exact."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


class Search:
    """Best-first search of one shard for many queries, round by round.

    In a round every open query takes its nearest page; queries at the same page are served
    together. A page or entry is left out, its distance never computed, where the distances to
    the parent already put it beyond the query's k-th result.
    """

    def __init__(self, raw: bytes, k: int):
        a = from_file(raw)
        self.width, self.leaves, self.root = (int(v) for v in a["shape"])
        self.top, self.k, self.a = float(a["top"][0]), k, a
        self.ids = a["ids"]
        self.ints = a["ints"].reshape(len(self.ids), -1)
        self.routes = lifted(a["route"].reshape(len(a["radius"]), -1), self.top)

    def run(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray):
        """Scores and ids (queries x k) of the best, NaN where there are fewer; distances
        computed per query. Only results of at least ``floor`` are sure to be found."""
        width = max(self.width, queries.shape[1])
        ints = np.pad(self.ints, ((0, 0), (0, width - self.width)))
        routes = np.insert(self.routes, [self.width] * (width - self.width), 0, axis=1)
        q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        n, pages = len(q), len(routes)
        lifted_q = np.hstack([q, np.zeros((n, 1))])
        square = (q * q).sum(axis=1) + self.top
        best = np.full((n, self.k), -np.inf)
        names = np.full((n, self.k), np.iinfo(np.int64).max)
        computed = np.zeros(n, dtype=np.int64)

        def reach(rows):
            """Distance beyond which nothing can enter a query's results."""
            score = np.maximum(best[rows, -1], floor[rows])
            return np.sqrt(np.maximum(square[rows] - 2 * score, 0)) * (1 + SLACK) + SLACK * np.sqrt(square[rows])

        distance = np.full((n, pages), np.nan)
        bound = np.full((n, pages), np.inf)
        at_root = np.arange(self.root, pages)
        distance[:, at_root] = distances(lifted_q, routes[at_root])
        bound[:, at_root] = np.maximum(distance[:, at_root] - self.a["radius"][at_root], 0)
        computed += len(at_root)
        rows = np.arange(n)
        while len(rows):
            page = bound[rows].argmin(axis=1)
            open_ = bound[rows, page] <= reach(rows)
            rows, page = rows[open_], page[open_]
            bound[rows, page] = np.inf
            order = np.argsort(page, kind="stable")
            heads = np.flatnonzero(np.diff(page[order], prepend=-1))
            for own in np.split(order, heads[1:]) if len(order) else []:
                p, r = int(page[own[0]]), rows[own]
                span = slice(int(self.a["begin"][p]), int(self.a["end"][p]))
                far = reach(r)[:, None]
                here = distance[r, p][:, None]
                if p >= self.leaves:
                    gap = np.abs(here - self.a["to_parent"][span]) - self.a["radius"][span]
                    near = gap <= far
                    use = np.flatnonzero(near.any(axis=0))
                    children = np.arange(span.start, span.stop)[use]
                    d = distances(lifted_q[r], routes[children])
                    near = near[:, use]
                    computed[r] += near.sum(axis=1)
                    distance[np.ix_(r, children)] = d
                    low = np.maximum(d - self.a["radius"][children], 0)
                    bound[np.ix_(r, children)] = np.where(near, low, np.inf)
                else:
                    near = np.abs(here - self.a["to_page"][span]) <= far
                    use = np.flatnonzero(near.any(axis=0))
                    ids = self.ids[span][use]
                    near = near[:, use]
                    computed[r] += near.sum(axis=1)
                    score = _exact(q[r], ints[span][use])
                    score[~near | (ids[None] == query_ids[r][:, None])] = -np.inf
                    all_scores = np.hstack([best[r], score])
                    all_ids = np.hstack([names[r], np.broadcast_to(ids, score.shape)])
                    top = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
                    best[r] = np.take_along_axis(all_scores, top, axis=1)
                    names[r] = np.take_along_axis(all_ids, top, axis=1)
        best[best == -np.inf] = np.nan
        return best, names, computed


_FOUND = "query_id long, vec_id long, score long, computed long, own_shard int"


def _search(k: int, own_only: bool):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("query_id", "vec_id", "score", "computed", "own_shard")}
        if trees.num_rows and queries.num_rows:
            ids = queries["query_id"].to_numpy()
            floor = np.full(len(ids), -np.inf)
            if not own_only:
                floor = queries["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
                floor = np.where(np.isnan(floor), -np.inf, floor)
            best, names, computed = Search(trees["file"][0].as_py(), k).run(
                ids, matrix(queries["ints"]), floor
            )
            q, c = np.nonzero(~np.isnan(best))
            out = {
                "query_id": ids[q],
                "vec_id": names[q, c],
                "score": best[q, c].astype(np.int64),
                "computed": np.where(c == 0, computed[q], 0),
                "own_shard": queries["shard"].to_numpy()[q],
            }
        return pa.table(
            {
                n: pa.array(v, pa.int32() if n == "own_shard" else pa.int64())
                for n, v in out.items()
            }
        )

    return run


def nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell``, the pivot nearest to ``ints``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("ints"))
                width = max(x.shape[1], pivots.shape[1])
                x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                p = np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
                cell = distances(x, p).argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32())],
                    names=[*batch.schema.names, "cell"],
                )

    return rows.mapInArrow(run, "vec_id long, ints array<long>, cell int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score and the distances computed for the query.

    ``vectors`` has vec_id and embedding; a query's candidates are all rows with another vec_id.
    Equal scores go by the smaller vec_id. Of equal vectors only the k + 1 smallest ids can be
    results, so no more are indexed. Missing ids and vectors that are missing or hold missing or
    non-finite components take no part; a shorter vector counts as ended by zeros. Rows repeated
    alike count once. Other columns are ignored.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = usable.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        integers(F.col("embedding")).alias("ints"),
        is_query.alias("is_query"),
    )
    rows = stored(rows.dropDuplicates(["vec_id", "ints"]), "vectors")
    copies = Window.partitionBy("ints").orderBy("vec_id")
    few = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    few = stored(few.select("vec_id", "ints"), "candidates")
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda s, x: s + x * x)
    size, top = few.agg(F.count("*"), F.max(square)).first()
    top = float(top or 0)
    wanted = min(max(-(-size // SHARD_ROWS), 1), MAX_PIVOTS)
    chosen = few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("ints").collect()
    pivots = matrix(pa.array([r["ints"] for r in chosen], pa.list_(pa.int64())))
    if not len(pivots):
        pivots = np.zeros((1, 1))

    celled = stored(nearest_pivot(few, pivots), "cells")
    # A crowded cell is dealt to several shards.
    counts = celled.groupBy("cell").count().orderBy("cell").collect()
    shards, first = {}, 0
    for r in counts:
        shards[r["cell"]] = (first, -(-r["count"] // SHARD_ROWS))
        first += shards[r["cell"]][1]

    def shard_of(cell: Column, deal: Column) -> Column:
        begin = F.element_at(F.create_map(*_literals({c: s[0] for c, s in shards.items()})), cell)
        n = F.element_at(F.create_map(*_literals({c: s[1] for c, s in shards.items()})), cell)
        return (begin + F.pmod(deal, n)).cast("int")

    if not shards:
        shards = {0: (0, 1)}
    placed = celled.withColumn("shard", shard_of(F.col("cell"), F.xxhash64("vec_id")))

    def grow(table: pa.Table) -> pa.Table:
        file = build(table["vec_id"].to_numpy(), matrix(table["ints"]), top)
        return pa.table(
            {"shard": table["shard"][:1], "file": pa.array([file], pa.binary())}
        )

    trees = stored(placed.groupBy("shard").applyInArrow(grow, "shard int, file binary"), "trees")
    asked = rows.where("is_query").select("vec_id", "ints")
    queries = nearest_pivot(asked, pivots).withColumn(
        "shard", F.coalesce(shard_of(F.col("cell"), F.xxhash64("vec_id")), F.lit(0))
    )
    queries = stored(queries.withColumnRenamed("vec_id", "query_id").drop("cell"), "queries")
    near = stored(
        trees.groupBy("shard")
        .cogroup(queries.groupBy("shard"))
        .applyInArrow(_search(k, True), _FOUND),
        "near",
    )
    floor = near.groupBy("query_id", "own_shard").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("floor")
    )
    floored = queries.join(
        floor.withColumnRenamed("own_shard", "shard"), ["query_id", "shard"], "left"
    )
    everywhere = F.filter(
        F.sequence(F.lit(0), F.lit(max(first - 1, 0))), lambda s: s != F.col("shard")
    )
    rest = floored.select("query_id", "ints", "floor", F.explode(everywhere).alias("shard"))
    far = (
        trees.groupBy("shard")
        .cogroup(rest.groupBy("shard"))
        .applyInArrow(_search(k, False), _FOUND)
    )
    found = near.union(far).dropDuplicates(["query_id", "vec_id", "score", "own_shard"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    total = F.sum("computed").over(Window.partitionBy("query_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .withColumn("computed", total)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "computed")
    )


def _literals(values: dict[int, int]) -> list[Column]:
    return [F.lit(x) for pair in (values or {0: 0}).items() for x in pair]
