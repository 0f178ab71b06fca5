r"""Operator 1: n-gram Jaccard self-join with several global token orders.

A document's set is that of its distinct runs of five words.  Two sets with a
Jaccard similarity of at least 80 % share one of the first
``n - ceil(0.8 n) + 1`` tokens under *any* global order, so a candidate must
share such a prefix token under each of several orders.  The orders put rare
tokens first and differ in the pseudo-random order within a frequency class.
The first order makes the candidate buckets; the others filter the candidates
before the exact comparison of the whole sets.

Frequencies are counted over the whole corpus: tokens are dealt by ranges of their
hash as sorted, delta-coded blocks, and each range leaves one segment of three
Bloom filters (tokens of at least 2, 16 and 256 documents).  The filters have a
fixed size and no false negatives, so a token outside the first one is in one
document alone: it comes first in every order and needs no bucket.  A document
that has as many such tokens as its prefix is long can't have a partner; most
documents, and near copies that differ too much, go no further.  False positives
only cost time, since any global order is a right one.

Exact copies (equal sets) are collapsed to their smallest doc_id first, by a
pre-aggregated grouping on 128 bits of digest and the size.  Groups of near
copies are linked through pivots (see ``linking``), never as all pairs.

Words are `[^\x20\x09-\x0D]+` of the text with A-Z in lower case.  Defined
results: null, empty and wordless texts have an empty set and are linked with
nothing; fewer than five words form one token; rows that repeat a doc_id are one
node of the graph; rows with a null doc_id take no part and get a null
component; an empty table gives an empty result.  Tokens are 64-bit hashes of
their words; only tokens of two compared documents can be confused, at a chance of
about 1e-13 a pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayscope.llm.common import LOWER, U64, bit_sketches, fresh, lean, list_array, mix, quoted, row_of, runs, seeds, span_hashes, texts, window_hashes, written
from strayscope.llm.linking import bloom, connected_components, link, maybe_in, near

WORDS = 5
SIMILARITY = 80
ORDERS = 3
LEVELS = (2, 16, 256)
FILTER_BYTES = (1 << 24, 1 << 22, 1 << 20)
#: text bytes for one range of token hashes, tokens sorted at once by a task
RANGE_BYTES, BLOCK_TOKENS = 8 << 20, 1 << 20
#: bytes of text whose arrays a task holds at a time
AT_ONCE = 1 << 19
#: longs of a document's odd sketch, which bounds how many tokens two sets differ in
SKETCH = 16
#: documents whose sets a task keeps while it compares pairs
CACHED_DOCS = 2048
#: the bits of a token that are counted; the rest would only swell the shuffle
KEPT_BITS = np.uint64((1 << 64) - (1 << 20))
SEEDS = seeds(8, 3)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def token_sets(column: pa.Array):
    """Slices (first row, rows, owner row and hash of each distinct token, sorted)."""
    for first, end, raw, offs in texts(column, AT_ONCE):
        data = LOWER[raw]
        starts, ends = runs(~SEPARATOR[data], offs)
        words, owner = span_hashes(data, starts, ends), row_of(starts, offs)
        n = end - first
        counts = np.bincount(owner, minlength=n)
        tokens, rows = window_hashes(words, WORDS), owner[:max(0, len(owner) - WORDS + 1)]
        whole = rows == owner[WORDS - 1:] if len(rows) else np.zeros(0, bool)
        tokens, rows = tokens[whole], rows[whole]
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(short):
            at = np.cumsum(counts) - counts
            extra = [window_hashes(words[at[r]:at[r] + counts[r]], int(counts[r]))[0] ^ SEEDS[counts[r]] for r in short]
            tokens, rows = np.concatenate([tokens, np.array(extra, U64)]), np.concatenate([rows, short])
        order = np.lexsort((tokens, rows))
        tokens, rows = tokens[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
        yield first, n, rows[new], tokens[new]


def prefix_length(n, similarity: int = SIMILARITY):
    """Tokens of a set of ``n`` one of which every similar set shares."""
    return n - -(-similarity * n // 100) + 1


# ------------------------------------------------------ token frequencies

class Frequencies:
    """Frequency class (0 for a token of one document, 1, 2, 3) from Bloom filters
    with one segment for each range of hashes: ``filters[level][range]``."""

    def __init__(self, filters: list[np.ndarray]):
        self.filters = filters

    @staticmethod
    def home(tokens: np.ndarray, ranges: int) -> np.ndarray:
        return (((tokens >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)

    @staticmethod
    def bits(tokens: np.ndarray, wide: int) -> np.ndarray:
        """Three bit numbers of each token in a segment of ``wide`` bytes."""
        return np.stack([mix(tokens ^ SEEDS[5 - k]) % U64(8 * wide) for k in range(3)]).astype(np.int64)

    def level(self, tokens: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(tokens), np.int64), np.arange(len(tokens))
        for segments in self.filters:
            ranges, wide = segments.shape
            home, hit = self.home(tokens[open_], ranges), np.ones(len(open_), bool)
            for b in self.bits(tokens[open_], wide):
                hit &= (segments[home, b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
            open_ = open_[hit]
            out[open_] += 1
        return out


def pack(sorted_tokens: np.ndarray) -> bytes:
    """Sorted tokens as byte planes of their differences (zero planes compress away)."""
    return np.diff(sorted_tokens, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=U64)


def token_frequencies(docs: DataFrame) -> Frequencies:
    """The frequency filters of all tokens (``FILTER_BYTES``, whatever the corpus)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(64, -(-size // RANGE_BYTES))
    wide = [max(1, b // ranges) for b in FILTER_BYTES]

    def deal(batches):
        def blocks(held):
            tokens = np.sort(np.concatenate(held))
            cuts = np.searchsorted(Frequencies.home(tokens, ranges), np.arange(ranges + 1))
            used = np.flatnonzero(np.diff(cuts)).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array([pack(tokens[cuts[r]:cuts[r + 1]]) for r in used], pa.binary())], names=["range", "tokens"])

        held, n = [], 0
        for batch in batches:
            for _, _, _, tokens in token_sets(batch.column(0)):
                held.append(tokens & KEPT_BITS)
                n += len(tokens)
                if n >= BLOCK_TOKENS:
                    yield blocks(held)
                    held, n = [], 0
        if n:
            yield blocks(held)

    def count(group: pa.Table) -> pa.Table:
        tokens, counts = np.unique(np.concatenate([unpack(raw) for raw in group.column("tokens").to_pylist()]), return_counts=True)
        rows = []
        for least, size in zip(LEVELS, wide, strict=True):
            bits = np.zeros(8 * size, bool)
            bits[Frequencies.bits(tokens[counts >= least], size).ravel()] = True
            rows.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"range": pa.array([group.column("range")[0].as_py()] * len(rows), pa.int32()),
                         "level": pa.array(range(len(rows)), pa.int32()), "bits": pa.array(rows, pa.binary())})

    dealt = docs.mapInArrow(lean(deal), "range int, tokens binary")
    found = dealt.groupBy("range").applyInArrow(count, "range int, level int, bits binary")
    out = [np.zeros((ranges, w), np.uint8) for w in wide]
    for r in found.collect():  # FILTER_BYTES in all
        out[r["level"]][r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return Frequencies(out)


def order_keys(tokens: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """Sort keys of the ``k``-th global order: frequency class, then a hash."""
    return (levels.astype(U64) << U64(60)) | (mix(tokens ^ SEEDS[k]) >> U64(4))


def prefixes(rows: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """Which of the tokens (sorted by row) are in the prefix of their row and occur
    in another document too."""
    alone = np.bincount(rows[levels == 0], minlength=len(sizes))
    left = prefix_length(sizes) - alone  # places that are left for shared tokens
    some = np.flatnonzero((levels > 0) & (left > 0)[rows])
    order = some[np.lexsort((order_keys(tokens[some], levels[some], k), rows[some]))]
    shared = np.bincount(rows[some], minlength=len(sizes))
    rank = np.arange(len(order)) - np.repeat(np.cumsum(shared) - shared, shared)
    out = np.zeros(len(rows), bool)
    out[order] = rank < left[rows[order]]
    return out


def signatures(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, parts, sketch, d1, d2, prefix): set size, its tokens that other
    documents have by frequency class, odd sketch of all tokens, 128-bit digest, such
    tokens of the first-order prefix.  ``shared``: the broadcast frequencies."""

    def run(batches):
        frequencies = shared.value
        for batch in batches:
            for first, n, rows, tokens in token_sets(batch.column(1)):
                sizes = np.bincount(rows, minlength=n)
                start = np.cumsum(sizes) - sizes
                digests = []
                for k in (6, 7):
                    total = np.zeros(len(tokens) + 1, U64)
                    with np.errstate(over="ignore"):
                        np.cumsum(mix(tokens ^ SEEDS[k]), out=total[1:])
                        digests.append((total[start + sizes] - total[start]).view(np.int64))
                levels = frequencies.level(tokens & KEPT_BITS)
                kept = prefixes(rows, tokens, sizes, levels, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(sizes, pa.int64()), list_array(
                        np.bincount((rows * len(LEVELS) + levels - 1)[levels > 0], minlength=n * len(LEVELS)).astype(np.int32),
                        np.full(n, len(LEVELS)), pa.int32()),
                     list_array(bit_sketches(rows, mix(tokens ^ SEEDS[4]), n, SKETCH, odd=True).ravel(), np.full(n, SKETCH), pa.int64()),
                     *(pa.array(d) for d in digests),
                     list_array(tokens[kept].view(np.int64), np.bincount(rows[kept], minlength=n), pa.int64())],
                    names=["doc_id", "n", "parts", "sketch", "d1", "d2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, parts array<int>, sketch array<long>, d1 long, d2 long, prefix array<long>")


class Document:
    """A document's set, and its shared prefix tokens under the further orders."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        rows, size = np.zeros(len(tokens), np.int64), np.array([len(tokens)])
        self.tokens = tokens
        self.heads = [tokens[prefixes(rows, tokens, size, levels, k)] for k in range(1, ORDERS)]


def similar(a: Document, b: Document) -> bool:
    """Candidate test under the further orders, then the exact comparison."""
    n, m = len(a.tokens), len(b.tokens)
    if not n or not m or 100 * min(n, m) < SIMILARITY * max(n, m):
        return False
    if not all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a.heads, b.heads, strict=True)):
        return False
    both = len(np.intersect1d(a.tokens, b.tokens, assume_unique=True))
    return 100 * both >= SIMILARITY * (n + m - both)


def verifier(docs: DataFrame, shared, details: DataFrame):
    """Prepares, for the doc_ids that have a bucket in common with another, the test
    of pairs; ``details`` are passed on.  Only texts that a pair may need are shuffled: a fixed-size filter
    drops most others at the scan."""

    def prepared(ids: DataFrame):
        bits = docs.sparkSession.sparkContext.broadcast(bloom(ids))

        def needed(batches):
            for batch in batches:
                yield batch.filter(pa.array(maybe_in(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))

        some = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(needed, "doc_id long, text string")
        some = written(some, "candidate-texts")

        def run(batches):
            frequencies, cache = shared.value, {}
            for batch in batches:
                columns = [batch.column(2).to_pylist(), batch.column(3).to_pylist()]
                new = list({t for c in columns for t in c} - cache.keys())
                if len(cache) + len(new) > CACHED_DOCS:
                    cache, new = {}, list({t for c in columns for t in c})
                done = 0
                for _, n, rows, tokens in token_sets(pa.array(new, pa.large_string())):
                    cuts = np.searchsorted(rows, np.arange(1, n))
                    for own, level in zip(np.split(tokens, cuts), np.split(frequencies.level(tokens & KEPT_BITS), cuts), strict=True):
                        cache[new[done]] = Document(own, level)
                        done += 1
                keep = [similar(cache[x], cache[y]) for x, y in zip(*columns, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def verify(pairs: DataFrame) -> DataFrame:
            joined = (pairs.join(some.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
                      .join(some.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b"))
            return joined.mapInArrow(lean(run), "a long, b long").distinct()

        return written(details.join(ids, "id", "left_semi"), "details"), verify

    return prepared


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    docs = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(token_frequencies(docs.select("text")))
    signed = written(signatures(docs, shared), "signatures")
    named = signed.filter("doc_id IS NOT NULL AND n > 0")
    classes = named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    heads = classes.select(F.col("rep").alias("doc_id")).distinct()
    buckets = (named.select("doc_id", "n", "prefix").filter("size(prefix) > 0").join(heads, "doc_id", "left_semi")
               .select(F.explode("prefix").alias("bucket"), F.col("doc_id").alias("id"), F.col("n").cast("int").alias("size")).distinct())
    details = named.select(F.col("doc_id").alias("id"), F.col("n").alias("size"), "parts", "sketch").dropDuplicates()
    # tokens in common, by frequency class: no more than the smaller count of each
    common = " + ".join(f"least(x.parts[{k}], y.parts[{k}])" for k in range(len(LEVELS)))
    enough = f"{100 + SIMILARITY} * ({common}) >= {SIMILARITY} * (x.size + y.size)"
    found = link(buckets, SIMILARITY, verifier(docs, shared, details), near(SIMILARITY, SKETCH, enough))
    # rows that repeat a doc_id with another text carry their links over to it
    classes = classes.join(found, classes["rep"] == found["id"], "left").select(
        "d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    rows = written(rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")), "row-components")
    # rows of one doc_id with several texts join the components of these texts
    torn = (rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("z"))
            .filter("a <> z").select("doc_id"))
    if not torn.limit(1).count():
        return rows
    edges = rows.join(torn, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    whole = connected_components(edges).select(F.col("id").alias("component_id"), "component")
    return rows.join(whole, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest key) of each component."""
    kept = jaccard_components(docs, key, text).filter("doc_id = component_id")
    own = fresh(docs, "_kept")
    heads = kept.select(F.col("doc_id").alias(own)).distinct()
    return docs.join(heads, quoted(key).cast("long") == F.col(own), "left_semi").unionByName(docs.filter(quoted(key).isNull()))
