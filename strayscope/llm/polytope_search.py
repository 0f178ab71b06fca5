"""Approximate nearest neighbours by cross-polytope hashing, exact cosines.

Unit vectors, padded to a power of two, go through pseudo-rotations (three rounds of
random signs and a fast Hadamard transform).  A vector's bucket in a table is the signed
axis that its rotated form is nearest to; when the rows are many, a second rotation's
first axes split each bucket further.  A query probes the buckets nearest to its own in
each of the tables; what it finds there is compared exactly on the original vectors.

Equal vectors are one class, which keeps the smallest ids it can ever return, so a
group of copies of any size is one row in each table.  A bucket of many classes is dealt
over slices and its queries over blocks, both by the counts of the whole table: no task
holds more than one slice and one block, nothing is left out, and pairs never become rows:
each cell returns the best few of each query.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without vec_id.  Rows that repeat a vec_id and its vector count once; another
vector under the same vec_id is a query of its own, and no query finds its own vec_id.
Vectors of different lengths are never compared.  An empty table gives an empty one;
other columns don't matter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strayscope.llm.common import written

TABLES = 8
PROBES = 16  # buckets a table and query, times the root of the number of parts that a second rotation gives
TARGET = 1 << 15  # rows a bucket, from which on a second rotation splits them
LEAST_SLICE, MOST_SLICE = 1 << 10, 1 << 14  # classes of a bucket in one task
BLOCK = 1 << 13  # queries of a bucket in one task
ROUNDS = 3
NEAR = 1e-9  # cosines so close are decided by the exact measure


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Hadamard transform of the rows (their length a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(units: np.ndarray, table: int, which: int) -> np.ndarray:
    """The pseudo-rotation ``which`` (0 or 1) of ``table``, the same in every task."""
    n = units.shape[1]
    signs = np.random.default_rng([n, table, which]).choice([-1.0, 1.0], (ROUNDS, n))
    for s in signs:
        units = hadamard(units * s)
    return units


def signed_axes(x: np.ndarray) -> np.ndarray:
    """Coordinates along all signed axes: +e0, -e0, +e1, ..."""
    return np.stack([x, -x], 2).reshape(len(x), -1)


def padded_units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    units = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
    wide = 1 << max(0, (vectors.shape[1] - 1).bit_length())
    return np.pad(units, ((0, 0), (0, wide - vectors.shape[1])))


def buckets(units: np.ndarray, table: int, axes: int) -> np.ndarray:
    """Bucket of each vector; ``axes`` of the second rotation take part (0: none)."""
    at = signed_axes(rotated(units, table, 0)).argmax(1)
    if not axes:
        return at
    return at * 2 * axes + signed_axes(rotated(units, table, 1)[:, :axes]).argmax(1)


def probes(units: np.ndarray, table: int, axes: int, n: int) -> np.ndarray:
    """The ``n`` buckets of each query that lie nearest, its own first."""
    def gaps(x: np.ndarray) -> np.ndarray:
        along = signed_axes(x)
        return (along.max(1, keepdims=True) - along) ** 2

    far = gaps(rotated(units, table, 0))
    if axes:
        far = (far[:, :, None] + gaps(rotated(units, table, 1)[:, :axes])[:, None, :]).reshape(len(units), -1)
    n = min(n, far.shape[1])
    if n == far.shape[1]:
        return np.argsort(far, 1, kind="stable")
    return np.argpartition(far, n, 1)[:, :n]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def dealt_out(axes: int, n_probes: int, lean: bool, dims: str = "dim"):
    """Arrow function: the rows again for each table and bucket (``n_probes`` 0: the own
    one); ``lean`` leaves out all but the place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column(batch.schema.get_field_index(dims)))
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                units = padded_units(matrix(part.column(part.schema.get_field_index("vector")), int(dim)))
                for table in range(TABLES):
                    at = probes(units, table, axes, n_probes) if n_probes else buckets(units, table, axes)[:, None]
                    rows = np.repeat(np.arange(len(units)), at.shape[1])
                    place = {"dim": np.full(len(rows), dim, np.int32), "tab": np.full(len(rows), table, np.int32), "bucket": at.ravel().astype(np.int64)}
                    if lean:
                        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in place.items()})
                    else:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v) for v in place.values()] + [part.column(i).take(pa.array(rows)) for i in range(part.num_columns) if part.schema.names[i] != dims],
                            names=[*place, *[c for c in part.schema.names if c != dims]])
    return run


PLACE = "dim int, tab int, bucket long"


def best_of_cell(keep: int):
    """Arrow function of one cell (slice of a bucket, block of its queries): the ``keep``
    nearest ids of each query among the classes, by exact cosine, ties to smaller ids."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(classes: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(classes) or not len(queries):
            return schema.empty_table()
        dim = len(classes["vector"][0])
        base, wanted = matrix(classes["vector"], dim), matrix(queries["vector"], dim)
        units, ids = padded_units(base), classes["ids"].to_pylist()
        first = np.array([i[0] for i in ids], np.int64)
        a, b = np.asarray(queries["a"]), np.asarray(queries["b"])
        out: list[tuple[int, int, int, float]] = []
        step = max(1, (1 << 22) // len(units))
        for at in range(0, len(wanted), step):
            sims = padded_units(wanted[at:at + step]) @ units.T
            edge = np.partition(sims, -keep, 1)[:, -keep] if sims.shape[1] > keep else np.full(len(sims), -2.0)
            for k, row in enumerate(sims):
                near = np.flatnonzero(row >= edge[k] - NEAR)
                score = cosines(wanted[at + k], base[near])
                best = np.lexsort((first[near], -score))[:keep]
                listed = sorted((-score[j], i) for j in best for i in ids[near[j]])[:keep]
                out += [(a[at + k], b[at + k], i, -s) for s, i in listed]
        columns = list(zip(*out))
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
    return run


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of ``query`` with each row in double precision, each row summed alone (so
    equal rows get equal values anywhere); components are scaled first, which can't overflow."""
    query, rows = query / np.abs(query).max(), rows / np.abs(rows).max(1, keepdims=True)
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def second_axes(n: int, dim: int, target: int) -> int:
    """Axes of the second rotation that bring the mean bucket of ``n`` rows to ``target``."""
    first, axes = 2 << max(0, (dim - 1).bit_length()), 0
    while n > target * first * max(1, 2 * axes) and 2 * axes < first:
        axes = max(1, 2 * axes)
    return min(axes, first // 2)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding",
            target: int = TARGET, least_slice: int = LEAST_SLICE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, the rows
    whose id is divisible by ``every``, among all rows but its own."""
    own = rows.filter(F.col(key).isNotNull() & valid(F.col(vector))).select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.xxhash64(vector).alias("a"),
        F.xxhash64(F.lit(1), F.reverse(vector)).alias("b"))
    # 128 bits of hash stand for the vector; one row for each (vector, id), then the smallest ids of each vector
    own = own.groupBy("a", "b", "vec_id").agg(F.first("vector").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    own = written(own.withColumn("dim", F.size("vector")), "vectors")
    few = own.withColumn("r", rank).filter(F.col("r") <= k + 1)
    classes = few.groupBy("a", "b", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    classes = written(classes, "classes")
    asked = own.filter(F.col("vec_id") % every == 0)
    queries = written(asked.groupBy("a", "b", "dim").agg(F.first("vector").alias("vector")), "queries")
    sizes = classes.agg(F.count(F.lit(1)), F.max("dim")).first()
    n, dim = int(sizes[0]), int(sizes[1] or 1)
    axes = second_axes(n, dim, target)
    n_probes = round(PROBES * math.sqrt(max(1, 2 * axes)))
    n_buckets = (2 << max(0, (dim - 1).bit_length())) * max(1, 2 * axes)
    size = min(max(least_slice, 2 * n // n_buckets), MOST_SLICE)

    def places(side: DataFrame, probed: int, cap: int, name: str) -> DataFrame:
        found = side.select("dim", "vector").mapInArrow(dealt_out(axes, probed, True), PLACE)
        full = found.groupBy("dim", "tab", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)
        return full.select("dim", "tab", "bucket", F.ceil(F.col("n") / cap).cast("int").alias(name))

    # only buckets over the caps are listed: at most TABLES * rows / cap of them
    grid = places(classes, 0, size, "slices").join(places(queries, n_probes, block, "blocks"), ["dim", "tab", "bucket"], "full")
    grid = written(grid, "grid")
    small = grid.limit(1 << 18).count() < 1 << 18  # of 24 bytes: a few MB

    def celled(side: DataFrame, probed: int, mine: str, others: str) -> DataFrame:
        types = {f.name: f.dataType.simpleString() for f in side.schema}
        rest = [c for c in side.columns if c != "dim"]
        out = side.mapInArrow(dealt_out(axes, probed, False), PLACE + "".join(f", {c} {types[c]}" for c in rest))
        out = out.join(F.broadcast(grid) if small else grid, ["dim", "tab", "bucket"], "left")
        out = out.withColumn(mine, F.pmod(F.xxhash64("b", "a"), F.coalesce(mine, F.lit(1))).cast("int"))
        return out.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)))

    cell = ["dim", "tab", "bucket", "slices", "blocks"]
    held = celled(classes.select("dim", "a", "b", "ids", "vector"), 0, "slices", "blocks")
    sent = celled(queries.select("dim", "a", "b", "vector"), n_probes, "blocks", "slices")
    found = held.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(best_of_cell(k + 1), "a long, b long, vec_id long, score double")
    found = found.groupBy("a", "b", "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "a", "b").join(found, ["a", "b"]).filter(F.col("query_id") != F.col("vec_id"))
    ranks = F.row_number().over(Window.partitionBy("query_id", "a", "b").orderBy(*order))
    return pairs.withColumn("rank", ranks).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
