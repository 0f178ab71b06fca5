"""Operator 2: exact top-k inner-product search with KD-trees per shard.

Vectors become integers (floor of ``SCALE`` times each component).  Each task
cuts its rows into shards, builds a KD-tree over each (median splits of the widest
dimension, tight bounding boxes) and answers a block of queries by best-first
traversal: a box's bound is the largest inner product any point in it could have,
and the search of a tree ends when the best open bound is below the k-th score
so far.  That score is carried from shard to shard within a task, and starts at
what a first small search of some rows gives.  Each task returns k rows per query;
a window merges them.

Queries go in blocks of at most ``BLOCK`` (their number grows with the table, a
block doesn't); each block is one pass over the vectors.  Defined results:
null vectors, vectors with null or non-finite components and null ids take no
part; only vectors of the query's length are candidates; rows with the query's own
id are none; ties go to the smaller id; scores are exact integers (beyond 64 bits
they are cut to the range of long); an empty table gives an empty result."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayscope.llm.common import written

SCALE = 256
SHARD = 16384
LEAF = 128
BLOCK = 4096
SEED_ROWS = 4096
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def integers(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (ids, integer vectors as float64)} of the valid rows of (id, vector)."""
    vectors = batch.column(1)
    if not pa.types.is_list(vectors.type):
        vectors = vectors.cast(pa.list_(pa.float64()))
    ids, valid = batch.column(0), ~np.asarray(batch.column(0).is_null().to_numpy(zero_copy_only=False) | vectors.is_null().to_numpy(zero_copy_only=False))
    sizes = np.where(valid, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    offs = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[valid]).tolist() if d_any(sizes) else []:
        rows = np.flatnonzero(valid & (sizes == d))
        matrix = values[offs[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            matrix = np.floor(matrix * SCALE)
        ok = np.isfinite(matrix).all(axis=1)
        if d and ok.any():
            out[d] = ids[rows[ok]], matrix[ok]
    return out


def d_any(sizes: np.ndarray) -> bool:
    return bool(len(sizes)) and int(sizes.max()) > 0


class Tree:
    """KD-tree with tight bounding boxes; node i's points are rows ``lo[i]:hi[i]``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.first, self.end, self.kids, low, high = [], [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            node, part = len(self.first), points[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            self.first.append(a)
            self.end.append(b)
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            widest = int(np.argmax(high[-1] - low[-1]))
            if b - a > LEAF and high[-1][widest] > low[-1][widest]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], half)]
                stack += [(a, a + half, node), (a + half, b, node)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries x nodes: the largest inner product with any point of the box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


class Best:
    """The k best (score, id) so far of one query."""

    __slots__ = ("k", "scores", "ids", "floor")

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    @property
    def bar(self) -> float:
        """No lower score can be among the k best."""
        return max(self.floor, float(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.bar
        if keep.any():
            scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> None:
    """Best-first traversal of one tree for each query."""
    all_bounds = tree.bounds(queries)
    for q, (own, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        found, bound = best[q], all_bounds[q]
        heap = [(-bound[0], 0)]
        while heap:
            negative, node = heapq.heappop(heap)
            if -negative < found.bar:
                break
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    if bound[kid] >= found.bar:
                        heapq.heappush(heap, (-bound[kid], kid))
            else:
                a, b = tree.first[node], tree.end[node]
                ids, scores = tree.ids[a:b], tree.points[a:b] @ query
                if scores.max() >= found.bar:
                    other = ids != own
                    found.add(scores[other], ids[other])


def wide(points: np.ndarray, queries: np.ndarray) -> bool:
    """Could a score lose digits in a double?"""
    return float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1]) >= EXACT


def search_exactly(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Whole numbers of any size, for components beyond usual embeddings."""
    rows = [[int(x) for x in p] for p in points]
    for own, query in zip(query_ids.tolist(), queries, strict=True):
        q = [int(x) for x in query]
        scored = sorted((-max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(q, r, strict=True)))), i) for i, r in zip(ids.tolist(), rows, strict=True) if i != own)
        yield [(own, i, -s) for s, i in scored[:k]]


def shards(batches):
    """{dimension: (ids, vectors)} pieces of at most ``SHARD`` rows (plus a batch)."""
    held: dict[int, list] = {}
    for batch in batches:
        for d, got in integers(batch).items():
            mine = held.setdefault(d, [])
            mine.append(got)
            if sum(len(i) for i, _ in mine) >= SHARD:
                yield d, *(np.concatenate(x) for x in zip(*held.pop(d), strict=True))
    for d, mine in held.items():
        yield d, *(np.concatenate(x) for x in zip(*mine, strict=True))


FOUND = "query_id long, vec_id long, score long"


def search_block(vectors: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int, floors: dict[int, np.ndarray]) -> DataFrame:
    """The k best of each task's rows for the queries of a block."""

    def run(batches):
        best: dict[int, list[Best]] = {}
        rows: list[tuple[int, int, int]] = []
        for d, ids, points in shards(batches):
            if d not in block:
                continue
            query_ids, queries = block[d]
            if wide(points, queries):
                for part in search_exactly(ids, points, query_ids, queries, k):
                    rows += part
                continue
            if d not in best:
                best[d] = [Best(k, f) for f in floors.get(d, np.full(len(query_ids), -np.inf)).tolist()]
            search(Tree(ids, points), query_ids, queries, best[d])
        for d, all_best in best.items():
            for own, b in zip(block[d][0].tolist(), all_best, strict=True):
                rows += [(own, i, int(s)) for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def query_blocks(vectors: DataFrame, every: int):
    """The queries in blocks of about ``BLOCK`` rows: {dimension: (ids, vectors)}."""
    chosen = vectors.filter(F.col("vec_id") % every == 0)
    n = chosen.count()
    blocks = -(-n // BLOCK)
    for k in range(blocks):  # each read holds one block
        part = chosen if blocks == 1 else chosen.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k)
        yield integers(part.toArrow().combine_chunks().to_batches()[0]) if n else {}


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose id is
    divisible by ``every``."""
    vectors = embeddings.select(embeddings[key].cast("long").alias("vec_id"), embeddings[vector].cast("array<double>").alias("v"))
    vectors = vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL")
    found = []
    for block in query_blocks(vectors, every):
        # a bar for each query from the scores of a few rows; all rows are searched below
        seed = search_block(vectors.limit(SEED_ROWS), block, k, {}).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar"))
        bars = {r["query_id"]: r["bar"] for r in seed.collect() if r["n"] == k}
        floors = {d: np.array([float(bars.get(i, -np.inf)) for i in ids.tolist()]) for d, (ids, _) in block.items()}
        found.append(written(search_block(vectors, block, k, floors), "top-k"))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("int"))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
