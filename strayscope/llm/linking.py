"""Linking of near copies without all pairs: candidate buckets, verified links and
distributed connected components.

``link`` takes candidate buckets (two records can only be linked if they share a
bucket) and a verifier of pairs.  It finds the same components as verifying every
pair would, in two phases: first, in a few turns, each record is paired with one
pivot of its bucket and of about its size, which joins most members of a large group by
a number of pairs linear in its size; then only pairs whose ends are still in different
components are verified.  Pairs within a component can't change it, so none is lost.
The second turn cuts the sizes halfway between the cuts of the first one and takes
another pivot in each bucket: a record whose pivot lay beyond a cut, or wasn't similar
enough, meets several members of its group there, instead of all of them later."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayscope.llm.common import U64, mix, written

EDGE = "a long, b long"


# ------------------------------------------------------------- components

def _forest(batches):
    """Spanning forest of the edges of one partition, as (node, smallest node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
    nodes = [x for x in parent if root(x) != x]
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k:k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); ``component`` is the
    smallest node reachable.  Alternating large-star and small-star rounds, each
    written to the shared folder, until each node has one edge, to the smallest of its
    component; different edges are first contracted within partitions."""

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = e.join(low, "b").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        return small.select("e.a", "e.b").filter("a <> b").distinct()

    def done(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()

    e = written(edges.filter("a <> b").select("a", "b").distinct().mapInArrow(_forest, EDGE), "edges")
    while not done(e):
        e = written(stars(e), "edges")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


# ---------------------------------------------------------------- linking

#: bucket numbers that a record carries to tell where a pair comes up first
LEAST = 32
#: one turn of pivots each: the record whose id comes first after some bits are flipped,
#: the same in all buckets or others in each, and what is added before sizes are cut to bands
PIVOTS = ((lambda: F.lit(0).cast("long"), 0.0), (lambda: F.xxhash64("bucket"), 0.5))


def near(similarity: int, sketch: int, more: str = "true") -> str:
    """Condition that every linked pair of records x, y meets.  ``sketch`` longs of
    bits differ in no more places than the sets do in elements, and two linked sets
    do in (100 - similarity) of (100 + similarity) parts of both sizes at most."""
    sizes = f"100 * least(x.size, y.size) >= {similarity} * greatest(x.size, y.size)"
    apart = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(sketch))
    return f"{sizes} AND {100 + similarity} * ({apart}) <= {100 - similarity} * (x.size + y.size) AND {more}"


def link(buckets: DataFrame, similarity: int, prepare: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
         near: str, lone: bool = True) -> DataFrame:
    """(id, component) of every record with a link.

    ``buckets``: bucket long, id long, size int, distinct rows, written already if none of
    them is the only one of its bucket (``lone``).  ``prepare`` gets the
    ids that have a bucket in common with another, and gives a table of their id and
    what the condition ``near`` of records x and y reads, which no linked pair fails,
    and the function that keeps the links of given pairs (a, b)."""
    shared = buckets
    if lone:
        shared = buckets.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket")
        shared = written(buckets.join(shared, "bucket"), "buckets")
    details, verify = prepare(shared.select("id").distinct())

    # turns with one pivot in each bucket and band of sizes, another one each time
    scale = (F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / similarity))).alias("scale")
    known, links, tried = shared.select("bucket", "id", scale, F.col("id").alias("c")), [], []
    for flipped, shift in PIVOTS:
        rows = known.withColumn("band", F.floor(F.col("scale") + F.lit(shift)).cast("int"))
        pivots = rows.groupBy("bucket", "band").agg(F.min(F.col("id").bitwiseXOR(flipped())).alias("b"))
        pivots = pivots.select("bucket", "band", F.col("b").bitwiseXOR(flipped()).alias("b"))
        pairs = rows.join(pivots, ["bucket", "band"]).filter("id <> b")
        if links:
            homes = known.select(F.col("id").alias("b"), F.col("c").alias("cb")).distinct()
            pairs = pairs.join(homes, "b").filter("c <> cb")
        pairs = pairs.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
        pairs = (pairs.join(details.alias("x"), F.expr("a = x.id")).join(details.alias("y"), F.expr(f"b = y.id AND {near}")).select("a", "b"))
        tried.append(written(pairs, "pairs"))
        links.append(written(verify(tried[-1]), "links"))
        found = written(connected_components(reduce(DataFrame.unionByName, links)), "components")
        # what is left: buckets whose records lie in different components
        known = known.drop("c").join(found, "id", "left").select("bucket", "id", "scale", F.coalesce("component", "id").alias("c"))
        mixed = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bucket")
        known = written(known.join(mixed, "bucket"), "mixed")

    # every pair that shares a bucket and lies in different components
    # a pair counts in the smallest bucket that both carry, or in each if they carry none together
    carried = known.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("bucket")), 1, LEAST).alias("least"))
    known = written(known.drop("scale").join(carried, "id").join(details, "id"), "mixed")
    once = "x.bucket = coalesce(array_min(array_intersect(x.least, y.least)), x.bucket)"
    rest = (known.alias("x").join(known.alias("y"), F.expr(f"x.bucket = y.bucket AND x.c < y.c AND {near} AND {once}"))
            .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"), F.col("x.c").alias("lo"), F.col("y.c").alias("hi")).distinct())
    rest = written(rest.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti"), "pairs")
    # first one pair of each two components, then those that are still apart
    one = rest.groupBy("lo", "hi").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    one = written(one, "pairs")
    links.append(written(verify(one), "links"))
    found = written(connected_components(reduce(DataFrame.unionByName, links)), "components")
    for end in ("a", "b"):
        home = found.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        rest = rest.join(home, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    rest = rest.filter("ca <> cb").select("a", "b").join(one, ["a", "b"], "left_anti")
    links.append(written(verify(written(rest, "pairs")), "links"))
    return connected_components(reduce(DataFrame.unionByName, links))


# ------------------------------------------------------- membership filter

BLOOM_BITS = 1 << 25
BLOOM_HASHES = 4


def _bloom_bits(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(U64)
    return np.concatenate([mix(x ^ U64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1)) % U64(BLOOM_BITS) for k in range(BLOOM_HASHES)])


def bloom(ids: DataFrame) -> np.ndarray:
    """Bloom filter (a fixed 4 MB) of the first column.  Only its size is bounded:
    a full one lets more rows through to the join behind it, and loses none."""
    pieces = 64

    def fill(batches):
        bits = None
        for batch in batches:
            bits = np.zeros(BLOOM_BITS >> 3, np.uint8) if bits is None else bits
            at = _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        if bits is not None:
            for k, part in enumerate(np.split(bits, pieces)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=["k", "bits"])

    def merge(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(raw, np.uint8)
                out[k] = out[k] | got if k in out else got
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()])], names=["k", "bits"])

    schema = "k int, bits binary"
    rows = ids.mapInArrow(fill, schema).repartition(pieces, "k").mapInArrow(merge, schema).collect()  # 64 pieces of 64 kB
    out = np.zeros((pieces, BLOOM_BITS // 8 // pieces), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def maybe_in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bloom_bits(ids).astype(np.int64)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).reshape(BLOOM_HASHES, -1).all(axis=0)
