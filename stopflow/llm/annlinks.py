"""Near-duplicate vectors by a flat graph with robustly pruned edges.

Vectors of a label are dealt to cells around sampled centroids, overlapping at the borders. Each
shard of a cell builds a graph of pruned neighbour lists; a vector's lists from all its shards are
united. Then every vector searches the graph of its home cell, greedily from the medoids and its
own list, and from what it finds in range on through everything in range. Found pairs
are checked by their exact cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.components import components
from stopflow.llm.mtree import matrix, valid
from stopflow.session import stored

THRESHOLD = 0.98
# Rows a cell should have, cells over all labels at most, cells a vector should lie in on average,
# and the rows above which a cell is dealt to several shards.
CELL_ROWS, MAX_CELLS, OVERLAP, SHARD_ROWS = 1_500, 1_024, 4, 4_000
# Candidates and neighbours of a node, pruning factor, medoids, and width of the search.
POOL, DEGREE, ALPHA, MEDOIDS, BEAM = 40, 20, 1.2, 16, 16
QUERY_BLOCK = 256
# Vectors that try the centroids of a label, and slack of the border test for rounded products.
TRIAL_ROWS, ROUNDING = 1_000, 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def memberships(x: np.ndarray, centroids: np.ndarray, threshold: float):
    """(row, cell, is_home) of every cell of each unit vector.

    A vector belongs to its nearest centroid and to all those whose border it is close to: a
    vector within the threshold may lie beyond. So of two linked vectors each lies in the home
    cell of the other.
    """
    near = x @ centroids.T
    home = near.argmax(axis=1)
    width = np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 0))
    margin = np.sqrt(max(1 - threshold**2, 0.0))
    every = np.arange(len(x))
    close = near[every, home][:, None] - near <= margin * width[home] + ROUNDING
    close[every, home] = True
    row, cell = np.nonzero(close)
    return row, cell, cell == home[row]


def work(others: np.ndarray, centroids: np.ndarray, threshold: float, rows: int) -> tuple[float, float]:
    """Cells a vector lies in on average, and rows that the shards of all ``rows`` hold or answer."""
    _, cell, is_home = memberships(others, centroids, threshold)
    scale, k = rows / len(others), len(centroids)
    held = np.bincount(cell, minlength=k) * scale
    asking = np.bincount(cell[is_home], minlength=k) * scale
    return len(cell) / len(others), float((held + asking * np.ceil(held / SHARD_ROWS)).sum())


def spread(sample: np.ndarray, others: np.ndarray, threshold: float, rows: int) -> np.ndarray:
    """Centroids out of a sample of unit vectors, for a label of ``rows`` vectors.

    Within twice the link radius of each other only the first is taken: a dense group is one
    cell. So many of them stay as make the least work, as judged by the ``others``, with a vector
    in at most ``OVERLAP`` cells on average. Larger cells are dealt to more shards, and no vector
    loses a cell; where borders are near to most vectors, one cell that all ask is the least.
    """
    reach = 2 * threshold**2 - 1
    taken: list[int] = []
    for i, v in enumerate(sample):
        if not taken or (sample[taken] @ v).max() < reach:
            taken.append(i)
    best, least = taken[:1] if len(others) else taken, np.inf
    while len(taken) and len(others):
        cells, rows_met = work(others, sample[taken], threshold, rows)
        if cells <= OVERLAP and rows_met < least:
            best, least = taken, rows_met
        taken = taken[: len(taken) * 3 // 4]
    return sample[best]


def pruned_lists(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to): up to ``DEGREE`` robustly pruned neighbours, and as many back edges."""
    n = len(x)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rng = np.random.default_rng(seed)
    pool = min(POOL, n - 1)
    kept = []
    for at in range(0, n, QUERY_BLOCK):
        own = np.arange(at, min(at + QUERY_BLOCK, n))
        near = x[own] @ x.T
        near[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        # A few far nodes keep the graph in one piece.
        far = rng.integers(0, n, (len(own), max(pool // 4, 1)))
        pick = np.hstack([best, far])
        close = np.take_along_axis(near, pick, axis=1)
        order = np.argsort(-close, axis=1, kind="stable")
        pick, close = np.take_along_axis(pick, order, 1), np.take_along_axis(close, order, 1)
        among = np.einsum("ijd,ikd->ijk", x[pick], x[pick], optimize=True)
        away = np.sqrt(np.maximum(2 - 2 * close, 0))
        apart = np.sqrt(np.maximum(2 - 2 * among, 0))
        alive = close > -np.inf
        for _ in range(DEGREE):
            some = np.flatnonzero(alive.any(axis=1))
            if not len(some):
                break
            j = alive[some].argmax(axis=1)
            kept.append((own[some], pick[some, j]))
            alive[some] &= ALPHA * apart[some, j] > away[some]
            alive[some, j] = False
    a = np.concatenate([k[0] for k in kept])
    b = np.concatenate([k[1] for k in kept])
    # Back edges: the nearest ``DEGREE`` of the nodes that list a node.
    closeness = (x[a] * x[b]).sum(axis=1)
    order = np.lexsort((-closeness, b))
    heads = np.flatnonzero(np.diff(b[order], prepend=-1))
    sizes = np.diff(np.append(heads, len(order)))
    rank = np.arange(len(order)) - np.repeat(heads, sizes)
    back = order[rank < DEGREE]
    return np.concatenate([a, b[back]]), np.concatenate([b, a[back]])


class Graph:
    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        width = max((len(v) for v in lists), default=0)
        self.x = x
        self.near = np.full((len(x), max(width, 1)), -1, dtype=np.int64)
        for i, v in enumerate(lists):
            self.near[i, : len(v)] = v
        step = max(len(x) // MEDOIDS, 1)
        middle = x.mean(axis=0)
        by_middle = np.argsort(-(x @ middle), kind="stable")
        self.medoids = by_middle[::step][:MEDOIDS]

    def in_range(self, q: np.ndarray, own: np.ndarray, threshold: float):
        """Pairs (query, node) found at or above the threshold. ``own``: a query's node, or -1."""
        n, m = len(q), len(self.x)
        seen = np.zeros((n, m), dtype=bool)
        hits = []

        def visit(i, node):
            """New pairs and their cosines; each pair is computed once."""
            ok = node >= 0
            flat = np.unique(i[ok] * m + node[ok])
            flat = flat[~seen.reshape(-1)[flat]]
            seen.reshape(-1)[flat] = True
            i, node = flat // m, flat % m
            cos = np.einsum("ij,ij->i", q[i], self.x[node])
            inside = cos >= threshold
            hits.append((i[inside], node[inside]))
            return i, node, cos

        rows = np.arange(n)
        start = np.hstack([np.tile(self.medoids, (n, 1)), own[:, None]])
        i, node, cos = visit(np.repeat(rows, start.shape[1]), start.reshape(-1))
        beam = np.full((n, BEAM), -np.inf)
        at = np.full((n, BEAM), -1, dtype=np.int64)
        done = np.zeros((n, BEAM), dtype=bool)
        while True:
            if len(i):
                # Merge new nodes into the beams: rank them within their query.
                order = np.lexsort((-cos, i))
                i, node, cos = i[order], node[order], cos[order]
                heads = np.flatnonzero(np.diff(i, prepend=-1))
                rank = np.arange(len(i)) - np.repeat(heads, np.diff(np.append(heads, len(i))))
                top = rank < BEAM
                new = np.full((n, BEAM), -np.inf)
                new_at = np.full((n, BEAM), -1, dtype=np.int64)
                new[i[top], rank[top]], new_at[i[top], rank[top]] = cos[top], node[top]
                beam, at = np.hstack([beam, new]), np.hstack([at, new_at])
                done = np.hstack([done, np.zeros((n, BEAM), dtype=bool)])
                best = np.argsort(-beam, axis=1, kind="stable")[:, :BEAM]
                beam, at, done = (np.take_along_axis(v, best, 1) for v in (beam, at, done))
            ready = ~done & (at >= 0)
            go = np.flatnonzero(ready.any(axis=1))
            if not len(go):
                break
            j = ready[go].argmax(axis=1)
            done[go, j] = True
            next_nodes = self.near[at[go, j]]
            i, node, cos = visit(np.repeat(go, next_nodes.shape[1]), next_nodes.reshape(-1))
        # From all that is in range to its neighbours, until nothing new is in range.
        k = 0
        while k < len(hits):
            i, node = hits[k]
            k += 1
            if len(i):
                next_nodes = self.near[node]
                visit(np.repeat(i, next_nodes.shape[1]), next_nodes.reshape(-1))
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs: every node points at the smallest of its tree, level by level."""
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


_MEMBER = "node long, copies long, label long, cell int, home boolean, vec array<double>"


def _centroids(rows: DataFrame, threshold: float) -> dict[int, np.ndarray]:
    """Sampled centroids of labels with several cells; at most ``MAX_CELLS`` in all."""
    total = rows.count()
    cells = F.least(
        F.ceil(F.col("n") / CELL_ROWS), F.floor(F.lit(float(MAX_CELLS)) * F.col("n") / max(total, 1))
    )
    wanted = rows.groupBy("label").agg(F.count("*").alias("n")).select("label", "n", cells.alias("k"))
    counts = {r["label"]: (r["k"], r["n"]) for r in wanted.where("k > 1").collect()}
    out = {}
    for label, (k, n) in sorted(counts.items()):
        own = rows.where(F.col("label") == label).orderBy(F.xxhash64("node"), "node")
        first = own.limit(int(k) + TRIAL_ROWS).collect()
        x = unit(matrix(pa.array([r["vec"] for r in first])))
        out[label] = spread(x[: int(k)], x[int(k) :], threshold, n)
    return out


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept: one row per row of (vec_id, embedding, label).

    Vectors that are missing, zero, or hold missing or non-finite components, and rows without
    label or id link with nothing and are kept. Equal vectors of a label are one node of the
    graph and count as linked copies. Shorter vectors count as ended by zeros. Rows repeated
    alike are one vector; other columns are ignored.
    """
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    usable = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    usable = usable.where(valid(F.col("vec"))).where((norm > 0) & (norm < float("inf")))
    usable = usable.dropDuplicates(["vec_id", "label", "vec"])
    classes = stored(
        usable.groupBy("label", "vec").agg(
            F.min("vec_id").alias("node"), F.count("*").alias("copies")
        ),
        "vector-classes",
    )
    centroids = _centroids(classes, threshold)

    def deal(batches):
        for batch in batches:
            label = batch.column("label").to_numpy()
            vec = batch.column("vec")
            x = matrix(vec)
            for one in np.unique(label):
                own = np.flatnonzero(label == one)
                if int(one) in centroids:
                    c = centroids[int(one)]
                    width = max(x.shape[1], c.shape[1])
                    padded = np.pad(unit(x[own]), ((0, 0), (0, width - x.shape[1])))
                    c = np.pad(c, ((0, 0), (0, width - c.shape[1])))
                    row, cell, home = memberships(padded, c, threshold)
                else:
                    row, cell = np.arange(len(own)), np.zeros(len(own), dtype=np.int64)
                    home = np.ones(len(own), dtype=bool)
                rows = batch.take(pa.array(own[row]))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("node"),
                        rows.column("copies"),
                        rows.column("label"),
                        pa.array(cell, pa.int32()),
                        pa.array(home),
                        rows.column("vec"),
                    ],
                    names=["node", "copies", "label", "cell", "home", "vec"],
                )

    members = stored(
        classes.select("node", "copies", "label", "vec").mapInArrow(deal, _MEMBER), "members"
    )
    sizes = members.groupBy("label", "cell").agg(
        F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("subs")
    )
    members = members.join(sizes, ["label", "cell"])
    sharded = members.withColumn("sub", F.pmod(F.xxhash64("node"), "subs").cast("int"))
    key = ["label", "cell", "sub"]

    def build(table: pa.Table) -> pa.Table:
        a, b = pruned_lists(unit(matrix(table["vec"])))
        node = table["node"].to_numpy()
        return pa.table({"node": node[a], "to": node[b]})

    edges = sharded.groupBy(*key).applyInArrow(build, "node long, to long")
    # A node has at most two pruned lists from each of its cells.
    lists = edges.groupBy("node").agg(F.collect_set("to").alias("near"))
    placed = sharded.join(lists, "node", "left").withColumn("asks", F.lit(False))
    # A vector asks every shard of its home cell, its own and the others.
    asking = members.where("home").withColumn(
        "sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))
    )
    asking = asking.withColumns({"near": F.lit(None).cast("array<long>"), "asks": F.lit(True)})

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy(zero_copy_only=False)
        nodes, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        out = {"node": [], "links": [], "root": []}
        if nodes.num_rows and queries.num_rows:
            name = nodes["node"].to_numpy()
            by_name = np.argsort(name, kind="stable")
            ordered = name[by_name]

            def local(x):
                at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
                return np.where(ordered[at] == x, by_name[at], -1)

            lists = []
            for v in nodes["near"].to_pylist():
                found = local(np.array(v or [], dtype=np.int64))
                lists.append(found[found >= 0])
            both = matrix(table["vec"])
            x, q = unit(both[~asks]), unit(both[asks])
            graph = Graph(x, lists)
            copies = nodes["copies"].to_numpy()
            q_name = queries["node"].to_numpy()
            own = local(q_name)
            # Union over nodes and queries: queries that are no node here stand behind the nodes.
            place = np.where(own >= 0, own, len(name) + np.arange(len(q)))
            parent = np.arange(len(name) + len(q))
            links = np.zeros(len(q), dtype=np.int64)
            for at in range(0, len(q), QUERY_BLOCK):
                span = slice(at, at + QUERY_BLOCK)
                i, node = graph.in_range(q[span], own[span], threshold)
                other = name[node] != q_name[span][i]
                i, node = i[other], node[other]
                links[span] += np.bincount(
                    i, weights=copies[node], minlength=len(q_name[span])
                ).astype(np.int64)
                parent = _joined(parent, place[span][i], node)
            names = np.concatenate([name, q_name])
            tied = np.flatnonzero(parent != np.arange(len(parent)))
            out["node"] = np.concatenate([q_name, names[tied]])
            out["links"] = np.concatenate([links, np.zeros(len(tied), dtype=np.int64)])
            out["root"] = np.concatenate([q_name, names[parent[tied]]])
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    columns = [*key, "node", "copies", "vec", "near", "asks"]
    found = stored(
        placed.select(*columns)
        .unionByName(asking.select(*columns))
        .groupBy(*key)
        .applyInArrow(search, "node long, links long, root long"),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(links, "node", "left")
        .join(parts, "node", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("vec").alias("_vec"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    label = F.when(F.col("vec_id").isNotNull(), F.col("label"))
    joined = base.withColumn("_key", label).join(
        per_class, (F.col("_key") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left"
    )
    own = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def audit(vectors: DataFrame, found: DataFrame, every: int = 20) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by ``every``.

    The true links come from comparing these vectors with all rows of their label, in blocks.
    """
    usable = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    usable = usable.where("vec_id IS NOT NULL AND label IS NOT NULL").where(valid(F.col("vec")))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = usable.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("q"), "label", F.col("vec").alias("qv")
    )
    blocks = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = usable.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = unit(matrix(left["qv"])), unit(matrix(right["vec"]))
        other = left["q"].to_numpy()[:, None] != right["vec_id"].to_numpy()
        return pa.table({"q": left["q"], "n": ((a @ b.T >= THRESHOLD) & other).sum(axis=1)})

    true = (
        blocks.groupBy("label", "part")
        .cogroup(rows.groupBy("label", "part"))
        .applyInArrow(compare, "q long, n long")
    )
    there = true.agg(F.sum("n")).first()[0] or 0
    seen = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return seen, there
