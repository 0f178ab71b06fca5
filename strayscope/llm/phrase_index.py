"""Operator 10: distributed positional inverted index for decontamination.

The training corpus is indexed once per block of test terms: each slice of
documents becomes one written row that holds, for every test term in it, the
sorted list of its positions (a running word number within the slice, so a
phrase may not cross documents: a gap separates them).  The index is sharded by
documents, thus a phrase is searched without any shuffle: for each window of
test words the terms of a shard are taken from the rarest on, their lists are
moved back by the term's offset, and intersected.

The test side is read to the driver in blocks of at most ``BLOCK_WORDS`` words
(one block for any usual benchmark; larger ones take more passes over the
corpus, and hits of all blocks are merged per row).  Defined results: null or
wordless texts have no words and no hits; items with a null id or no words take
no part; items that repeat an id count as one; each row of a repeated key is
reported for itself; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayscope.llm.common import LOWER, fresh, lean, list_array, quoted, row_of, runs, span_hashes, texts, written

WINDOW = 10
BLOCK_WORDS = 1 << 20
U64 = np.uint64

#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

INDEX = ("row array<long>, key array<long>, n_words array<int>, term array<long>, "
         "size array<int>, position array<int>")


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hash of each word, words per row) for slices of a text column."""
    for first, end, raw, offs in texts(column):
        data = LOWER[raw]
        starts, ends = runs(WORD_BYTE[data], offs)
        yield first, span_hashes(data, starts, ends), np.bincount(row_of(starts, offs), minlength=end - first)


class Queries:
    """A block of test items: their windows, as rows of term numbers."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        ids, hashes, counts = [], [], []
        if items:
            for _, h, n in words_of(pa.array([t for _, t in items], pa.large_string())):
                hashes.append(h)
                counts.append(n)
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        flat = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.terms, codes = np.unique(flat, return_inverse=True)
        ends = np.cumsum(np.concatenate(counts)) if counts else np.zeros(0, np.int64)
        owners: dict[tuple, set[int]] = {}
        for (item, _), end, n in zip(items, ends, np.concatenate(counts) if counts else [], strict=True):
            row = codes[end - n:end]
            for w in ([row[i:i + width] for i in range(n - width + 1)] if n >= width else [row] if n else []):
                owners.setdefault(tuple(w.tolist()), set()).add(number[item])
        self.windows = [(np.array(w), sorted(o)) for w, o in owners.items()]

        # the windows as one table of term numbers, short ones padded with -1
        self.codes = np.full((len(self.windows), width), -1, np.int64)
        for k, (w, _) in enumerate(self.windows):
            self.codes[k, :len(w)] = w

    def possible(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of the windows all of whose terms are among ``terms``."""
        there = np.zeros(len(self.terms) + 1, bool)
        there[-1] = True  # the padding
        there[np.searchsorted(self.terms, terms)] = True
        return np.flatnonzero(there[self.codes].all(axis=1))


# ------------------------------------------------------------------- index

def index_rows(batches, terms: np.ndarray, gap: int):
    """Index rows of Arrow batches (row number, key, text)."""
    for batch in batches:
        rows, keys = batch.column(0), batch.column(1)
        for first, hashes, counts in words_of(batch.column(2)):
            n = len(counts)
            # running word numbers, ``gap`` apart between documents
            place = np.arange(len(hashes)) + np.repeat(np.arange(n) * gap, counts)
            if len(terms):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                known = terms[at] == hashes
                at, place = at[known], place[known]
                order = np.argsort(at, kind="stable")
                at, place = at[order], place[order]
                used, sizes = np.unique(at, return_counts=True)
            else:
                used = sizes = place = np.zeros(0, np.int64)
            one = lambda v, kind: list_array(v, np.array([len(v)]), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.slice(first, n)),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys.slice(first, n)),
                 one(counts.astype(np.int32), pa.int32()), one(terms[used].view(np.int64), pa.int64()),
                 one(sizes.astype(np.int32), pa.int32()), one(place.astype(np.int32), pa.int32())],
                names=["row", "key", "n_words", "term", "size", "position"])


class Shard:
    """One index row, ready for searches."""

    def __init__(self, n_words: np.ndarray, term: np.ndarray, size: np.ndarray, position: np.ndarray, gap: int):
        self.n_words = n_words.astype(np.int64)
        ends = np.cumsum(self.n_words)
        self.starts = ends - self.n_words + np.arange(len(ends)) * gap
        ends, position, self.terms = np.cumsum(size), position.astype(np.int64), term.view(U64)
        self.lists = {t: position[e - s:e] for t, e, s in zip(self.terms.tolist(), ends.tolist(), size.tolist(), strict=True)}

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Start places of an exact phrase: lists from the rarest term on, moved
        back by their offsets and intersected."""
        found = [self.lists.get(t) for t in terms]
        if any(f is None for f in found):
            return np.zeros(0, np.int64)
        hits = None
        for k in sorted(range(len(terms)), key=lambda k: len(found[k])):
            if hits is None:
                hits = found[k] - k
            else:
                at = np.searchsorted(found[k], hits + k)
                at[at == len(found[k])] -= 1
                hits = hits[found[k][at] == hits + k]
            if not len(hits):
                break
        return hits

    def proximity(self, terms: list[int], reach: int) -> np.ndarray:
        """Places of the rarest term with every other term at most ``reach`` words
        away (in either direction) in the same document."""
        found = [self.lists.get(t) for t in dict.fromkeys(terms)]
        if any(f is None for f in found):
            return np.zeros(0, np.int64)
        found.sort(key=len)
        hits = found[0]
        for other in found[1:]:
            low, high = np.searchsorted(other, hits - reach), np.searchsorted(other, hits + reach, "right")
            near = low < high
            if near.any():  # a neighbour within reach may lie in the next document
                own = self.doc(hits)
                near &= np.array([bool((self.doc(other[a:b]) == d).any()) for a, b, d in zip(low, high, own, strict=True)], bool)
            hits = hits[near]
        return hits


def build_index(docs: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text", gap: int = WINDOW,
                row: str | None = None) -> DataFrame:
    """Write the positional index of ``docs`` over the given terms (sorted hashes).

    ``row`` numbers the rows (by a column of ``docs``, if named), so that rows with
    null or repeated keys stay apart."""
    number = quoted(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return written(rows.mapInArrow(lean(lambda batches: index_rows(batches, terms, gap)), INDEX), "phrase-index")


HITS = "row long, key long, n_words long, spans array<struct<first:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def search_rows(batches, queries: Queries, gap: int):
    """Per document: hit spans (word numbers in the document) and hit items."""
    terms = queries.terms.tolist()
    for batch in batches:
        for k in range(batch.num_rows):
            row, key, n_words, *lists = (batch.column(i)[k].values for i in range(6))
            shard = Shard(n_words.to_numpy(), *(v.to_numpy() for v in lists), gap)
            spans: list[list] = [[] for _ in range(len(row))]
            items: list[set] = [set() for _ in range(len(row))]
            for w in queries.possible(shard.terms).tolist():
                window, owners = queries.windows[w]
                hits = shard.phrase([terms[t] for t in window])
                if len(hits):
                    for d, h in zip(shard.doc(hits).tolist(), hits.tolist(), strict=True):
                        at = h - int(shard.starts[d])
                        spans[d].append({"first": at, "end": at + len(window)})
                        items[d].update(owners)
            yield pa.RecordBatch.from_arrays(
                [row, key, n_words.cast(pa.int64()),
                 pa.array([merged(s) for s in spans], SPANS),
                 pa.array([[queries.ids[i] for i in sorted(x)] for x in items], pa.list_(pa.string()))],
                names=["row", "key", "n_words", "spans", "items"])


def merged(spans: list[dict]) -> list[dict]:
    """Overlapping spans joined."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of a bounded number of words (by length, at least 2 bytes a word)."""
    rows = (items.filter(items[key].isNotNull() & items[text].isNotNull())
            .select(items[key].cast("string").alias("id"), items[text].alias("text")))
    sized = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = -(-(sized["b"] or 0) // (2 * BLOCK_WORDS)) or 1
    for k in range(blocks):  # each read holds one block
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        yield [(r["id"], r["text"]) for r in part.toLocalIterator()]


def contaminated_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                       item_text: str = "text", width: int = WINDOW, row: str | None = None) -> DataFrame:
    """Per row of ``docs``: row, key, n_words, merged hit spans, ids of hit items."""
    parts = []
    for block in item_blocks(items, item_key, item_text):
        queries = Queries(block, width)
        index = build_index(docs, queries.terms, key, text, width, row)
        parts.append(index.mapInArrow(lean(lambda batches, q=queries: search_rows(batches, q, width)), HITS))
    if len(parts) == 1:
        return parts[0]
    all_hits = reduce(DataFrame.unionByName, parts).groupBy("row").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def join_spans(batches):
        for batch in batches:
            spans = pa.array([merged(s) for s in batch.column(3).to_pylist()], SPANS)
            yield batch.set_column(3, "spans", spans)

    return all_hits.mapInArrow(join_spans, HITS)


def words_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contaminated_spans(docs, items, **options)
    ids = F.array_sort("items")
    return spans.select(
        F.col("key").alias("doc_id"), "n_words",
        words_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", max_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without the rows that have more than ``max_share`` of their words hit.

    Each row goes or stays by its own text, also if its key is null or another row's:
    the rows are numbered and written once, and found again by their number."""
    row = fresh(docs, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows")
    bad = (contaminated_spans(rows, items, key=key, row=row, **options).filter(words_hit() > max_share * F.col("n_words"))
           .select(F.col("row").alias(row)))
    return rows.join(bad, row, "left_anti").drop(row)
