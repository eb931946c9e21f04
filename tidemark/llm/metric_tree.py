"""Exact top-k inner products by best-first search in M-trees.

Inner product is no metric; one more coordinate makes it one. With R the greatest
norm, a vector x becomes (x, sqrt(R^2 - |x|^2)) and a query (q, 0); then
distance^2 = |q|^2 + R^2 - 2 q.x, and the nearest vectors have the highest products.

The vectors are dealt to trees by their nearest pivot (``PIVOTS`` vectors drawn by
hash); a large cell is dealt further by hash into trees of even size, so a vector that
a third of the rows share fills several trees. A tree has pages of ``PAGE`` vectors:
each page stores its routing vector, covering radius and distance to the tree's root,
each vector its distance to the routing vector. Trees number at most
``MAX_TREES + PIVOTS``, so the table of their roots is small and may be broadcast.

Search is best first: a query first searches the tree with the least bound
max(0, d(q, root) - radius), which gives it a k-th distance to beat; then it is sent to
every other tree whose bound does not exceed it. In a tree, stored distances exclude
pages, and in a page vectors, by the triangle inequality before their own distance
would be computed. Bounds get a slack above rounding error and products are computed
exactly, so the result is that of a full scan.

Defined results: vectors that are null, hold a null or non-finite component, or have
no id take no part, nor do those with a scaled component of 2^31 or more (no long would
hold their products); shorter vectors count as filled with zeros; equal scores go to the
smaller id, repeated rows of a candidate are repeated; rows with a query's id are its
own; a query id that repeats is searched once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 1024
PIVOTS = 32
TREE_SIZE = 4096
MAX_TREES = 4096
PAGE = 64
QUERY_BLOCK = 1024
SLACK = 1e-6


def scaled_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector) of the rows that take part; vector is floor(scale * x) as longs."""
    doubles = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * float(scale) < float(2**31), F.lit(False))
    )
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), doubles.cast("array<bigint>").alias("vector")
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled with zeros to ``width``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    rows = np.zeros((len(sizes), width), dtype=np.int64)
    rows[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return rows


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; by floating point where every sum is below 2**53."""
    if len(a) and len(b) and a.shape[1]:
        bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
        if bound < 2.0**53:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows.astype(float), rows.astype(float))


def _lift(rows: np.ndarray, limit: float) -> np.ndarray:
    """The further coordinate, sqrt(R^2 - |x|^2)."""
    return np.sqrt(np.maximum(limit - _squares(rows), 0.0))


def _distances(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Distances between two sets of lifted vectors."""
    gap = _squares(a)[:, None] + _squares(b)[None, :] - 2 * (a.astype(float) @ b.astype(float).T)
    gap += (_lift(a, limit)[:, None] - _lift(b, limit)[None, :]) ** 2
    return np.sqrt(np.maximum(gap, 0.0))


def _query_distances(queries: np.ndarray, rows: np.ndarray, limit: float) -> np.ndarray:
    gap = _squares(queries)[:, None] + limit - 2 * (queries.astype(float) @ rows.astype(float).T)
    return np.sqrt(np.maximum(gap, 0.0))


PAGES = (
    "tree long, page int, center array<bigint>, radius double, root_distance double,"
    " ids array<bigint>, vectors array<bigint>, distances array<double>"
)


def _tree_pages(tree: int, ids: np.ndarray, rows: np.ndarray, limit: float) -> Iterator[dict]:
    """Pages of one tree; page 0 is the root's own: its radius covers the whole tree."""
    order = np.lexsort((ids,))
    ids, rows = ids[order], rows[order]
    root = rows[:1]
    to_root = _distances(rows, root, limit)[:, 0]
    yield {
        "tree": tree, "page": 0, "center": root[0], "radius": float(to_root.max()), "root_distance": 0.0,
        "ids": [], "vectors": [], "distances": [],
    }
    n_pages = -(-len(rows) // PAGE)
    centers = rows[:: max(1, len(rows) // n_pages)][:n_pages]
    nearest = _distances(rows, centers, limit).argmin(axis=1)
    page = 0
    for center in range(len(centers)):
        members = np.flatnonzero(nearest == center)
        distance = _distances(rows[members], centers[center : center + 1], limit)[:, 0] if len(members) else None
        # A routing vector with many near ones has several pages, from the inside out.
        members = members[np.argsort(distance, kind="stable")] if len(members) else members
        distance = np.sort(distance, kind="stable") if len(members) else distance
        for start in range(0, len(members), PAGE):
            own, far = members[start : start + PAGE], distance[start : start + PAGE]
            page += 1
            yield {
                "tree": tree, "page": page, "center": centers[center], "radius": float(far.max()),
                "root_distance": float(_distances(centers[center : center + 1], root, limit)[0, 0]),
                "ids": ids[own], "vectors": rows[own].ravel(), "distances": far,
            }


def build_trees(vectors: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, int, float]:
    """Stored pages, roots (tree, center, radius), the width and R^2.

    ``vectors`` must be cheap to read again. Pivots are the only sample; every vector is indexed.
    """
    facts = vectors.agg(
        F.count("*").alias("n"),
        F.max(F.size("vector")).alias("width"),
        F.max(F.expr("aggregate(vector, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)")).alias("limit"),
    ).first()
    total, width, limit = facts["n"], facts["width"] or 0, float(facts["limit"] or 0.0)
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.zeros((len(chosen), width), dtype=np.int64)
    for k, row in enumerate(chosen):
        pivots[k, : len(row["vector"])] = row["vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _distances(_matrix(batch.column(1), width), pivots, limit).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), batch.column(0), batch.column(1)], ["cell", "vec_id", "vector"]
            )

    celled = vectors.select("vec_id", "vector").mapInArrow(assign, "cell int, vec_id long, vector array<bigint>")
    celled = stored(celled, folder, "celled")
    size = max(TREE_SIZE, -(-total // MAX_TREES))
    # One row per pivot.
    counts = F.broadcast(celled.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("_trees")))
    tree = F.expr("cell * 1000000L + pmod(xxhash64(vec_id, cell), _trees)").alias("tree")
    dealt = celled.join(counts, "cell").select(tree, "vec_id", "vector")

    def grow(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        pages = list(_tree_pages(table.column("tree")[0].as_py(), ids, _matrix(table.column("vector"), width), limit))
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        return pa.table(
            {
                "tree": pa.array([p["tree"] for p in pages], pa.int64()),
                "page": pa.array([p["page"] for p in pages], pa.int32()),
                "center": pa.array([p["center"] for p in pages], longs),
                "radius": pa.array([p["radius"] for p in pages], pa.float64()),
                "root_distance": pa.array([p["root_distance"] for p in pages], pa.float64()),
                "ids": pa.array([p["ids"] for p in pages], longs),
                "vectors": pa.array([p["vectors"] for p in pages], longs),
                "distances": pa.array([p["distances"] for p in pages], doubles),
            }
        )

    pages = stored(dealt.groupBy("tree").applyInArrow(grow, PAGES), folder, "pages")
    return pages, pages.where("page = 0").select("tree", "center", "radius"), width, limit


class _Best:
    """The k highest products so far, ties to smaller ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _bound(square: float, limit: float, score: float | None) -> float:
    """Distance that a vector must not exceed to matter, given the product to beat."""
    if score is None:
        return np.inf
    return float(np.sqrt(max(square + limit - 2.0 * score, 0.0))) * (1 + SLACK) + SLACK


def search_tree(
    query_id: int, query: np.ndarray, to_beat: int | None, root: dict, pages: list[dict], k: int, limit: float
) -> _Best:
    """Best-first search of one tree. ``pages`` hold center, radius, root_distance, ids, rows, distances."""
    best = _Best(k)
    square = float(_squares(query[None, :])[0])

    def bound() -> float:
        scores = [s for s in (to_beat, int(best.scores[-1]) if len(best.scores) == k else None) if s is not None]
        return _bound(square, limit, max(scores) if scores else None)

    d_root = float(_query_distances(query[None, :], root["center"][None, :], limit)[0, 0])
    near = np.abs(d_root - root["root_distances"]) - root["radii"] <= bound()
    places = np.flatnonzero(near)
    if not len(places):
        return best
    d_center = _query_distances(query[None, :], root["centers"][places], limit)[0]
    least = np.maximum(d_center - root["radii"][places], 0.0)
    for at in np.argsort(least, kind="stable").tolist():
        reach = bound()
        if least[at] > reach:
            break
        page = pages[places[at]]
        keep = (np.abs(d_center[at] - page["distances"]) <= reach) & (page["ids"] != query_id)
        if keep.any():
            best.add(products(query[None, :], page["rows"][keep])[0], page["ids"][keep])
    return best


HITS = "query_id long, vec_id long, score long"


def _search(asked: DataFrame, pages: DataFrame, width: int, limit: float, k: int) -> DataFrame:
    """Hits of (tree, query_id, query, to_beat) in their trees; queries of a tree go in blocks."""
    blocked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")))
    blocks = asked.groupBy("tree").agg(F.max("_blocks").alias("_blocks"))
    copied = pages.join(blocks, "tree").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("block")
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            rows = right.to_pylist()
            own = [r for r in rows if r["page"] > 0]
            top = next(r for r in rows if r["page"] == 0)
            pages = [
                {
                    "ids": np.array(r["ids"], dtype=np.int64),
                    "rows": np.array(r["vectors"], dtype=np.int64).reshape(-1, width),
                    "distances": np.array(r["distances"]),
                }
                for r in own
            ]
            root = {
                "center": np.array(top["center"], dtype=np.int64),
                "centers": np.array([r["center"] for r in own], dtype=np.int64).reshape(-1, width),
                "radii": np.array([r["radius"] for r in own]),
                "root_distances": np.array([r["root_distance"] for r in own]),
            }
            queries = _matrix(left.column("query"), width)
            for query, query_id, to_beat in zip(
                queries, left.column("query_id").to_pylist(), left.column("to_beat").to_pylist()
            ):
                best = search_tree(query_id, query, to_beat, root, pages, k, limit)
                found[0].extend([query_id] * len(best.ids))
                found[1].extend(best.ids.tolist())
                found[2].extend(best.scores.tolist())
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), found)})

    return (
        blocked.drop("_blocks")
        .groupBy("tree", "block")
        .cogroup(copied.drop("_blocks").groupBy("tree", "block"))
        .applyInArrow(search, HITS)
    )


def _sent(queries: DataFrame, roots: DataFrame, width: int, limit: float, first: bool) -> DataFrame:
    """Queries with the trees they must search: the nearest one, or all others within the bound."""
    # At most MAX_TREES + PIVOTS rows.
    table = roots.orderBy("tree").collect()
    trees = np.array([r["tree"] for r in table], dtype=np.int64)
    radii = np.array([r["radius"] for r in table])
    centers = np.zeros((len(table), width), dtype=np.int64)
    for place, row in enumerate(table):
        centers[place, : len(row["center"])] = row["center"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), width)
            least = np.maximum(_query_distances(rows, centers, limit) - radii[None, :], 0.0)
            nearest = least.argmin(axis=1)
            if first:
                chosen = np.zeros(least.shape, dtype=bool)
                chosen[np.arange(len(rows)), nearest] = True
            else:
                squares = _squares(rows)
                reach = np.array([_bound(s, limit, t) for s, t in zip(squares, batch.column(2).to_pylist())])
                chosen = least <= reach[:, None]
                chosen[np.arange(len(rows)), nearest] = False
            at, to = np.nonzero(chosen)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees[to]), *[taken.column(c) for c in range(3)]],
                ["tree", "query_id", "query", "to_beat"],
            )

    return queries.select("query_id", "query", "to_beat").mapInArrow(
        send, "tree long, query_id long, query array<bigint>, to_beat long"
    )


def top_k(vectors: DataFrame, queries: DataFrame, folder: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of every query, all if fewer.

    ``vectors`` has (vec_id, vector) and ``queries`` some of its rows.
    """
    vectors = stored(vectors, folder, "vectors")
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))
    asked = stored(asked.withColumn("to_beat", F.lit(None).cast("long")), folder, "queries")
    pages, roots, width, limit = build_trees(vectors, folder)
    blocks = F.lit(max(1, -(-asked.count() // QUERY_BLOCK))).cast("long").alias("_blocks")

    nearest = _sent(asked, roots, width, limit, first=True).select("*", blocks)
    probed = stored(_search(nearest, pages, width, limit, k), folder, "probed")
    to_beat = probed.groupBy("query_id").agg(
        F.when(F.count("*") >= k, F.min("score")).alias("to_beat")
    )
    bounded = asked.select("query_id", "query").join(to_beat, "query_id", "left")
    rest = _sent(bounded, roots, width, limit, first=False).select("*", blocks)
    hits = probed.union(_search(rest, pages, width, limit, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
