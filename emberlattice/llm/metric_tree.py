"""Exact top-k search by inner product: an M-tree of paged metric nodes, searched best page first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What float arithmetic on whole-number scores may be off by, with room to spare.
SLACK = 0.25


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of every component x as double; vectors that are null or hold null or non-finite components,
    and rows with a null id, are left out."""
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles; a shorter vector goes on with zeros."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        x = np.asarray(v.as_py(), dtype=np.float64)
        out[i, : len(x)] = x
    return out


@dataclass
class Space:
    """The metric space: a row x is the point (x, sqrt(limit - |x|^2)), a query q the point (q, 0), so that the nearest rows of a
    query are those with the largest inner products."""

    dim: int
    limit: float
    pivots: np.ndarray  # of a bounded sample of rows
    pivot_ids: np.ndarray

    def points(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.limit - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def tree_pages(rows: DataFrame, space, page: int, subtree_pages: int) -> DataFrame:
    """Leaf pages of at most `page` rows under subtrees of at most subtree_pages pages.

    Rows go to their nearest pivot; a pivot's rows are split over as many subtrees as their number asks for. A page stores its
    routing row, its covering radius, its distance to the parent pivot, and each entry's distance to the routing row.
    """
    dim = space.value.dim

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Space = space.value
        pivots = s.points(s.pivots)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            d = distances(s.points(x), pivots) if len(x) else np.zeros((0, len(pivots)))
            cols = [batch.column(0), pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1) if len(x) else d[:, 0]), pa.array([r.tobytes() for r in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "region", "to_parent", "x"])

    assigned = rows.mapInArrow(assign, "vec_id long, region int, to_parent double, x binary")
    sizes = assigned.groupBy("region").count()
    most = page * subtree_pages
    dealt = assigned.join(F.broadcast(sizes), "region").withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "x"), F.ceil(F.col("count") / most)).cast("int")
    )

    def cut(group: pa.Table) -> pa.Table:
        s: Space = space.value
        region, part = group["region"][0].as_py(), group["part"][0].as_py()
        ids, parents = group["vec_id"].to_numpy(), group["to_parent"].to_numpy()
        x = np.frombuffer(b"".join(v.as_py() for v in group["x"]), dtype=np.float64).reshape(-1, dim)
        pivot = s.points(s.pivots[region : region + 1])
        order = np.lexsort((ids, parents))
        out = []
        for a in range(0, len(order), page):
            own = order[a : a + page]
            points = s.points(x[own])
            middle = int(distances(points, points.mean(axis=0)[None, :])[:, 0].argmin())
            to_routing = distances(points, points[middle : middle + 1])[:, 0]
            out.append(
                (region, part, len(own), ids[own].astype(np.int64).tobytes(), x[own].tobytes(), to_routing.tobytes(), middle, float(to_routing.max()), float(distances(points[middle : middle + 1], pivot)[0, 0]))
            )
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, PAGE, strict=True)], schema=PAGE)

    return dealt.groupBy("region", "part").applyInArrow(
        cut, "region int, part int, n int, ids binary, x binary, to_routing binary, routing int, radius double, to_parent double"
    )


PAGE = pa.schema(
    [
        ("region", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("to_routing", pa.binary()),
        ("routing", pa.int32()), ("radius", pa.float64()), ("to_parent", pa.float64()),
    ]
)


class Best:
    """The k best rows so far of each query of a block: larger score first, then smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor  # a score that the k-th best of all rows has at least

    def bound(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (rows) with a page's entries; -inf: not to be taken."""
        s = np.concatenate([self.scores[q], scores], axis=1)
        i = np.concatenate([self.ids[q], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[q] = np.take_along_axis(s, order, axis=1)
        self.ids[q] = np.take_along_axis(i, order, axis=1)


def search_subtree(space: Space, pages: list[dict], query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Best:
    """Each query visits the subtree's pages in the order of their least possible distance, until that is beyond its k-th best.

    |d(query, pivot) - d(page, pivot)| - radius, with stored distances, rules pages out before the distance to their routing row
    is computed; |d(query, routing) - d(entry, routing)| does the same for entries. Queries that want one page are served
    together.
    """
    best = Best(len(queries), k, floors)
    square = (queries * queries).sum(axis=1)
    points = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    region = pages[0]["region"]
    to_pivot = distances(points, space.points(space.pivots[region : region + 1]))[:, 0]
    to_parent = np.array([p["to_parent"] for p in pages])
    radius = np.array([p["radius"] for p in pages])
    least = np.maximum(np.abs(to_pivot[:, None] - to_parent[None, :]) - radius[None, :], 0)

    def highest(least: np.ndarray) -> np.ndarray:
        """The largest inner product that a distance of at least this much allows."""
        return (square[:, None] + space.limit - least * least) / 2 + SLACK

    open_ = highest(least) >= best.bound()[:, None]
    to_page = np.full(least.shape, np.nan)
    for j, p in enumerate(pages):
        q = np.flatnonzero(open_[:, j])
        if len(q):
            to_page[q, j] = distances(points[q], space.points(p["x"][p["routing"]][None, :]))[:, 0]
    known = ~np.isnan(to_page)
    least = np.where(known, np.maximum(least, to_page - radius[None, :]), np.inf)
    turn = np.argsort(least, axis=1, kind="stable")
    for t in range(len(pages)):
        page_of = turn[:, t]
        wanted = np.take_along_axis(least, page_of[:, None], axis=1)
        going = np.isfinite(wanted[:, 0]) & (highest(np.where(np.isfinite(wanted), wanted, 0))[:, 0] >= best.bound())
        if not going.any():
            break
        for j in np.unique(page_of[going]).tolist():
            p = pages[j]
            q = np.flatnonzero(going & (page_of == j))
            gap = np.abs(to_page[q, j][:, None] - p["to_routing"][None, :])
            may = (square[q][:, None] + space.limit - gap * gap) / 2 + SLACK >= best.bound()[q][:, None]
            may &= p["ids"][None, :] != query_ids[q][:, None]
            entries = np.flatnonzero(may.any(axis=0))
            if len(entries):
                scores = np.where(may[:, entries], inner(queries[q], p["x"][entries]), -np.inf)
                scores[scores < best.bound()[q][:, None]] = -np.inf
                best.offer(q, scores, p["ids"][entries])
    return best


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles where all sums stay below 2^53, else as whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return a @ b.T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def top_k(
    vectors: DataFrame,
    query_filter,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    pivots: int = 64,
    page: int = 256,
    subtree_pages: int = 32,
    block: int = 4096,
    stored=lambda df: df,
) -> DataFrame:
    """The k rows with the highest inner products of floor(scale * x) for each query row; ties go to smaller ids.

    Queries are the rows for which query_filter (a condition on the column vec_id) holds, candidates all rows of other ids. The tree
    is fitted on a sample of at most `pivots` rows, the smallest by hash, and holds every row; blocks of about `block` queries
    meet every subtree. The sample's k-th best score is each query's first bound. Scores below 2^53 are exact.

    Returns query_id, rank (from 1), vec_id, score; fewer than k ranks where there are fewer rows. Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; a shorter vector goes on with zeros. Rows of one id are never
    one another's candidates; repeated rows of an id are candidates each, and queries of one id each have their list (equal rows
    share one). Empty tables give no rows. Other columns are never read.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector_col, scale))
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("limit")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not head["n"] or not head["dim"]:
        return empty
    dim = head["dim"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    x = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        x[i, : len(r["v"])] = r["v"]
    space = spark.sparkContext.broadcast(Space(dim, float(head["limit"]), x, np.array([r["vec_id"] for r in sample])))
    pages = stored(tree_pages(rows, space, page, subtree_pages))
    queries = rows.filter(query_filter).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-queries.count() // block))
    subtrees = pages.select(F.col("region").alias("to_region"), F.col("part").alias("to_part")).distinct()
    number = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    asked = queries.withColumn("block", number).join(subtrees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block")
    opened = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        s: Space = space.value
        own = []
        for r in left.to_pylist():
            own.append({k: r[k] for k in ("region", "radius", "to_parent", "routing")})
            own[-1] |= {
                "ids": np.frombuffer(r["ids"], np.int64), "x": np.frombuffer(r["x"], np.float64).reshape(-1, dim), "to_routing": np.frombuffer(r["to_routing"], np.float64)
            }
        if not own or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in FOUND], schema=FOUND)
        q = matrix(right["v"], dim)
        ids = right["vec_id"].to_numpy()
        first = np.where(s.pivot_ids[None, :] == ids[:, None], -np.inf, inner(q, s.pivots))
        floors = np.sort(first, axis=1)[:, -k] if first.shape[1] >= k else np.full(len(q), -np.inf)
        best = search_subtree(s, own, ids, q, floors, k)
        at, _ = rows_of = np.nonzero(np.isfinite(best.scores))
        keys = right["key"].to_numpy()
        cols = [ids[at], keys[at], best.ids[rows_of], best.scores[rows_of].astype(np.int64)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, FOUND, strict=True)], schema=FOUND)

    keyed = asked.withColumn("key", F.xxhash64("v"))
    found = (
        opened.groupBy("region", "part", "block")
        .cogroup(keyed.groupBy("to_region", "to_part", "block"))
        .applyInArrow(search, "query_id long, key long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
