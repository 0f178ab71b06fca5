"""Operator 5: fuzzy line deduplication by MinHash.

Lines (cut at ``\\n``, stripped, A-Z lower-cased) are compared by their sets of
character shingles (``SHINGLE`` bytes of UTF-8 at every position; a shorter line
is one shingle).  One-permutation MinHash signatures of 64 bins, empty bins
filled from a fixed pseudo-random other bin, are banded 16 x 4: lines at the threshold
of 0.8 share a band with probability 0.9998, at 0.9 with 0.9999999.  Candidates are
verified by the exact Jaccard similarity of their whole shingle sets, links are
joined to components (distributed star rounds), and the first line of each
component, by (doc_id, hash of the text, line number), stays.

Defined results: blank lines are layout and always stay; null and empty texts
have no lines; rows with a null doc_id take no part and keep their text; rows that
repeat doc_id and text count as one (their lines are at the same place), and rows
that repeat the doc_id only are told apart by 64 bits of hash of the text; an empty
table stays empty.  A line is known by 64 bits of hash; lines whose hash another
line shares (told apart by 64 more bits) take no part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayscope.llm.common import LOWER, U64, bit_sketches, fresh, lean, list_array, mix, quoted, row_of, seeds, span_hashes, text_hash, texts, window_hashes, written
from strayscope.llm.linking import bloom, link, maybe_in, near

SHINGLE = 8
SIMILARITY = 80
BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: longs of a line's odd sketch, which bounds how many shingles two lines differ in
SKETCH = 16
#: bytes of text at a time, few enough that the arrays over them stay in the cache
CACHED = 1 << 17
#: lines whose band keys a task holds, keys of a range, shared keys that every task may get
FLUSH, KEYS_PER_RANGE, BROADCAST_KEYS = 1 << 18, 1 << 21, 1 << 23
SEEDS = seeds(8, 5)
#: the bins that an empty bin asks in turn (every bin comes up in each list)
ASKED = np.argsort(mix(np.arange(BINS * BINS, dtype=U64) + SEEDS[0]).reshape(BINS, BINS), axis=1)
EMPTY = np.iinfo(np.uint64).max
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True


def line_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends (stripped) of the lines that aren't blank, row, line number."""
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.sort(np.concatenate([offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offs[1:]]))
    starts, ends = starts[ends > starts], ends[ends > starts]
    first, last = starts.copy(), ends.copy()
    edge = np.flatnonzero(SPACE[raw[starts]] | SPACE[raw[ends - 1]]) if len(starts) else starts
    if len(edge):  # the others have nothing to strip
        places = np.flatnonzero(~(SPACE[raw] | (raw == 10)))
        a, b = np.searchsorted(places, starts[edge]), np.searchsorted(places, ends[edge])
        some = a < b
        first[edge[some]], last[edge[some]] = places[a[some]], places[b[some] - 1] + 1
        keep = np.ones(len(starts), bool)
        keep[edge[~some]] = False
        starts, first, last = starts[keep], first[keep], last[keep]
    row = row_of(starts, offs)
    return first, last, row, np.searchsorted(breaks, starts) - np.searchsorted(breaks, offs[row])


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash) of the shingles at every position of the spans, and a second
    hash of each span, the sum over its shingles weighted by their places."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    counts = np.maximum(ends - starts - SHINGLE + 1, 1)
    owner = np.repeat(np.arange(len(starts)), counts)
    heads = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - np.repeat(heads, counts)
    padded = np.concatenate([data, np.zeros(SHINGLE, np.uint8)])
    codes = np.ndarray((len(data),), "<u8", padded, 0, (1,))  # the eight bytes from each position on
    codes = codes[place + np.repeat(starts, counts)]
    short = ends - starts < SHINGLE
    if short.any():  # the bytes behind a short line don't belong to it
        first = heads[short]
        codes[first] &= (U64(1) << (U64(8) * (ends - starts)[short].astype(U64))) - U64(1)
    hashed = mix(codes ^ SEEDS[4])
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(hashed * (2 * place + 1).view(U64), heads)
    return owner, hashed, sums


def distinct_marks(owner: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's different shingles: one sort of numbers that begin with the owner and go
    on with as many leading bits of the hash as fit, which are the hash from here on."""
    bits = U64(64 - max(1, n).bit_length())
    key = np.sort(owner.astype(U64) << bits | marks >> (U64(64) - bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> bits).astype(np.int64), key << (U64(64) - bits)


def signatures(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash: ``n`` x ``BINS``."""
    table = np.full(n * BINS, EMPTY, U64)
    np.minimum.at(table, owner * BINS + (hashes & U64(BINS - 1)).astype(np.int64), hashes)
    table = table.reshape(n, BINS)
    filled = table.copy()
    rows, bins = np.nonzero(table == EMPTY)
    for k in range(BINS):
        if not len(rows):
            break
        value = table[rows, ASKED[bins, k]]
        ok = value != EMPTY
        filled[rows[ok], bins[ok]] = mix(value[ok] ^ SEEDS[1])
        rows, bins = rows[~ok], bins[~ok]
    return filled


def bands(table: np.ndarray) -> np.ndarray:
    """Band keys, ``n`` x ``BANDS``: 32 bits, to which the bucket adds the band's number."""
    weights = seeds(ROWS, 6) | U64(1)
    with np.errstate(over="ignore"):
        parts = mix((table.reshape(len(table), BANDS, ROWS) * weights).sum(axis=2, dtype=U64))
        return (mix(parts + np.arange(BANDS, dtype=U64) * SEEDS[2]) >> U64(32)).astype(np.uint32)


def scan(column: pa.Array):
    """Slices (first row, bytes, starts, ends, row, line number, id) of lines."""
    for first, _, raw, offs in texts(column, CACHED):
        data = LOWER[raw]
        starts, ends, row, number = line_spans(data, offs)
        hashed = span_hashes(data, starts, ends)
        yield first, data, starts, ends, row, number, hashed


#: ``bands`` holds two 32-bit keys in each long
LONGS = BANDS // 2
LINES = "doc_id long, body long, line int, id long, check long, size int, bands array<long>"


def line_table(docs: DataFrame) -> DataFrame:
    """Every non-blank line of (doc_id, text, body) rows with its id and band keys."""

    def run(batches):
        for batch in batches:
            for first, data, starts, ends, row, number, hashed in scan(batch.column(1)):
                owner, marks, sums = shingles(data, starts, ends)
                keys = bands(signatures(owner, marks, len(starts))) if len(starts) else np.zeros((0, BANDS), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + row)), batch.column(2).take(pa.array(first + row)),
                     pa.array(number.astype(np.int32)), pa.array(hashed.view(np.int64)), pa.array(sums.view(np.int64)), pa.array(np.maximum(ends - starts - SHINGLE + 1, 1).astype(np.int32)),
                     list_array(keys.ravel().view(np.int64), np.full(len(keys), LONGS), pa.int64())],
                    names=["doc_id", "body", "line", "id", "check", "size", "bands"])

    return docs.mapInArrow(lean(run), LINES)


def shared_keys(signed: DataFrame, rows: int) -> DataFrame:
    """(band, keys binary, n): the band keys that several lines have, as sorted 32-bit
    numbers.  Each task sends a key once, four bytes, in lists by ranges of the keys."""
    fine = max(0, (rows // KEYS_PER_RANGE).bit_length())  # leading bits of a key that name its range

    def send(batches):
        held, size = [], 0

        def flush():
            for band in range(BANDS):
                keys, times = np.unique(np.concatenate([k[:, band] for k in held]), return_counts=True)
                cuts = np.searchsorted(keys, (np.arange((1 << fine) + 1, dtype=np.uint64) << U64(32 - fine)))
                for part, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a < b:
                        yield pa.RecordBatch.from_pydict({"band": pa.array([band], pa.int32()), "part": pa.array([part], pa.int32()),
                                                          "keys": [keys[a:b].tobytes()], "again": [keys[a:b][times[a:b] > 1].tobytes()]})

        for batch in batches:
            held.append(_band_keys(batch.column(0)))
            size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for c in ("keys", "again") for x in group.column(c).to_pylist()]
        keys, times = np.unique(np.concatenate(parts), return_counts=True)
        keys = keys[times > 1]
        return pa.table({"band": group.column("band").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    sent = signed.select("bands").mapInArrow(lean(send), "band int, part int, keys binary, again binary")
    return written(sent.groupBy("band", "part").applyInArrow(merge, "band int, keys binary, n long"), "shared-keys")


def _band_keys(column: pa.Array) -> np.ndarray:
    """n x BANDS unsigned 32-bit numbers."""
    return np.asarray(column.flatten()).view(np.uint32).reshape(-1, BANDS)


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """(bucket, id, size) of the band keys that other lines have too.

    The shared keys go to every task while they are few (BROADCAST_KEYS of four bytes);
    beyond that, the keys of all lines meet them in a join."""
    rows = distinct.count()
    shared = shared_keys(distinct, rows)
    if (shared.agg(F.sum("n")).first()[0] or 0) > BROADCAST_KEYS:
        def listed(batches):
            for batch in batches:
                for band, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keys = np.frombuffer(raw, np.uint32).astype(np.int64)
                    for at in range(0, len(keys), FLUSH):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + FLUSH] + (band << 32))], names=["bucket"])

        def every_key(batches):
            for batch in batches:
                own = _band_keys(batch.column(2))
                for band in range(BANDS):
                    yield pa.RecordBatch.from_arrays([pa.array(own[:, band].astype(np.int64) + (band << 32)), batch.column(0), batch.column(1)], names=["bucket", "id", "size"])

        every = distinct.select("id", "size", "bands").mapInArrow(every_key, "bucket long, id long, size int")  # an id is in one row
        return every.join(shared.select("band", "keys").mapInArrow(listed, "bucket long"), "bucket", "left_semi")

    keys = [[] for _ in range(BANDS)]
    for r in shared.collect():
        keys[r["band"]].append(np.frombuffer(r["keys"], np.uint32))
    known = distinct.sparkSession.sparkContext.broadcast([np.sort(np.concatenate(k)) if k else np.zeros(0, np.uint32) for k in keys])

    def run(batches):
        for batch in batches:
            own = _band_keys(batch.column(2))
            for band, some in enumerate(known.value):
                if not len(some):
                    continue
                at = np.minimum(np.searchsorted(some, own[:, band]), len(some) - 1)
                hit = np.flatnonzero(some[at] == own[:, band])
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(own[hit, band].astype(np.int64) + (band << 32)), batch.column(0).take(pa.array(hit)),
                                                      batch.column(1).take(pa.array(hit))], names=["bucket", "id", "size"])

    return distinct.select("id", "size", "bands").mapInArrow(run, "bucket long, id long, size int")


def shingle_set(line: bytes) -> set:
    return {line[k:k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def verifier(docs: DataFrame):
    """Prepares, for the ids of lines that have a bucket in common with another, the
    exact test of pairs of lines."""

    def prepared(ids: DataFrame):
        bits = docs.sparkSession.sparkContext.broadcast(bloom(ids))

        def needed(batches):
            for batch in batches:
                for _, data, starts, ends, _, _, hashed in scan(batch.column(1)):
                    keep = np.flatnonzero(maybe_in(bits.value, hashed.view(np.int64)))
                    _, one = np.unique(hashed[keep], return_index=True)
                    keep = keep[one]
                    owner, marks, _ = shingles(data, starts[keep], ends[keep])
                    owner, marks = distinct_marks(owner, marks, len(keep))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashed[keep].view(np.int64)),
                         pa.array([data[s:e].tobytes() for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)], pa.binary()),
                         pa.array(np.bincount(owner, minlength=len(keep)), pa.int64()),
                         list_array(bit_sketches(owner, marks, len(keep), SKETCH, odd=True).ravel(), np.full(len(keep), SKETCH), pa.int64())],
                        names=["id", "line", "size", "sketch"])

        some = written(docs.mapInArrow(lean(needed), "id long, line binary, size long, sketch array<long>").dropDuplicates(["id"]), "candidate-lines")
        lines = some.select("id", "line")

        def run(batches):
            last, own = None, set()
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if y != last:
                        last, own = y, shingle_set(y)
                    other = shingle_set(x)
                    both = len(own & other) if 100 * min(len(own), len(other)) >= SIMILARITY * max(len(own), len(other)) else 0
                    keep.append(100 * both >= SIMILARITY * (len(own) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def verify(pairs: DataFrame) -> DataFrame:
            joined = (pairs.join(lines.withColumnsRenamed({"id": "a", "line": "line_a"}), "a")
                      .join(lines.withColumnsRenamed({"id": "b", "line": "line_b"}), "b").select("a", "b", "line_a", "line_b"))
            return joined.mapInArrow(lean(run), "a long, b long")

        return some.select("id", "size", "sketch"), verify

    return prepared


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, lines): numbers of the lines to remove from each document, which
    is known by its doc_id and ``text_hash``."""
    docs = (docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), text_hash(text).alias("body"))
            .filter("doc_id IS NOT NULL"))
    lines = written(line_table(docs), "lines")
    # one row per distinct line: its first place; ids that two lines share drop out
    # a place is (doc_id, 31 bits of body, line): 126 bits
    within = F.shiftleft(F.col("body").bitwiseAND(F.lit((1 << 31) - 1)), 31) + F.col("line")
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 62).cast("decimal(19,0)") + within
    distinct = (lines.select("id", "check", "size", place.cast("decimal(38,0)").alias("place"), *[F.get("bands", F.lit(k)).alias(f"b{k}") for k in range(LONGS)])
                .groupBy("id").agg(F.min("place").alias("first"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("size").alias("size"), F.count(F.lit(1)).alias("times"),
                                   *[F.min(f"b{k}").alias(f"b{k}") for k in range(LONGS)]).filter("lo = hi"))
    distinct = written(distinct.select("id", "first", "size", "times", F.array(*[f"b{k}" for k in range(LONGS)]).alias("bands")), "distinct-lines")
    found = link(written(shared_buckets(distinct), "shared-buckets"), SIMILARITY, verifier(docs), near(SIMILARITY, SKETCH), lone=False)
    # a line that occurs once and has no link is its own first
    named = (distinct.select("id", "first", "times").join(found, "id", "left").filter("times > 1 OR component IS NOT NULL")
             .select("id", "first", F.coalesce("component", "id").alias("component")))
    heads = written(named.groupBy("component").agg(F.min("first").alias("head")), "line-heads")
    kept = named.join(heads, "component").select("id", "head")
    drop = lines.select("doc_id", "body", "line", "id").join(kept, "id").filter(place.cast("decimal(38,0)") != F.col("head"))
    return drop.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines cut from ``text`` (and the line break
    before each), and a column ``lines_removed``."""
    rest = docs.drop("lines_removed")
    own, body, cut = fresh(rest, "_key"), fresh(rest, "_body"), fresh(rest, "_lines")
    drop = removed_lines(docs, key, text).withColumnsRenamed({"doc_id": own, "body": body, "lines": cut})
    marked = rest.join(drop, (quoted(key).cast("long") == F.col(own)) & (text_hash(text) == F.col(body)), "left")
    keep = F.filter(F.split(quoted(text), "\n", -1), lambda _, i: ~F.array_contains(cut, i))
    clean = F.when(F.col(cut).isNull(), quoted(text)).otherwise(F.array_join(keep, "\n"))
    return marked.select(*[clean.alias(c) if c == text else quoted(c) for c in rest.columns],
                         F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("lines_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), lines_removed, clean_text."""
    clean = dedup_lines(docs.select("doc_id", F.col("text").alias("text")))
    solid = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike("[^ \t\\x0B\f\r]")))
    return clean.select("doc_id", (solid + F.col("lines_removed")).alias("n_lines"), "lines_removed", F.col("text").alias("clean_text"))
