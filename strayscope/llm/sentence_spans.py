"""Operator 3: substring deduplication by sliding sentence spans.

Sentences end at ``.``, ``!`` or ``?`` before white space, and at line breaks.  Sentences of
more than ``SHORT`` words are cut into pieces at places that the nearby words alone
decide (no piece has more than 2 * ``APART`` + ``WINDOW`` - 2 words), so that a passage has the
same pieces wherever it is pasted, also if its first and last sentence merge with their
surroundings.  From every unit (sentence or piece) on, the shortest run of at least ``UNITS``
units and ``WORDS`` words is a span, hashed word by word to 96 bits.  The first
occurrence of each span, by (doc_id, hash of the text, unit number), stays; units that
another occurrence covers are covered.  A sentence goes if it is covered whole; of sentences of
more than ``LONG`` words the covered pieces go.

Each task settles the repeats among the texts it holds itself: of a span that it has several
times only the first occurrence travels on, so a span that every text holds sends
a row per task.  What travels is sorted by hash, and all but the first of equal ones are
covered too.  Defined results: null and empty texts have no sentences; a document shorter
than a span has no spans; white space between words doesn't count (line breaks end
sentences); rows with a null doc_id take no part and keep their text; rows that repeat
doc_id and text count as one, and rows that repeat the doc_id only are told apart by
32 bits of hash of the text; an empty table stays empty."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayscope.llm.common import U64, fresh, mix, quoted, row_of, run_hashes, runs, seeds, span_hashes, text_hash, texts, written

UNITS, WORDS = 2, 8
#: words of a sentence that is one unit; of one that goes only as a whole
SHORT, LONG = 12, 20
#: words between a cut and the ends of its sentence; places of which the least is a cut
APART, WINDOW = 4, 7
#: spans that a task settles among themselves
TOGETHER = 1 << 20
LOW = (1 << 32) - 1
SEEDS = seeds(4, 7)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
STOP = np.zeros(256, bool)
STOP[[0x21, 0x2E, 0x3F]] = True


def sentences(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (stripped), row, and words of each sentence."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    space = SPACE[raw]
    cut = raw == 10
    cut[1:] |= space[1:] & STOP[raw[:-1]]
    starts, ends = runs(~cut, offs)
    solid = np.concatenate([[0], np.cumsum(~space)])
    keep = solid[ends] > solid[starts]
    starts, ends = starts[keep], ends[keep]
    places = np.flatnonzero(~space)
    first, last = places[solid[starts]], places[solid[ends] - 1] + 1
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.concatenate([[0], np.cumsum(begins)])
    inside = words[last] - words[first + 1] + 1
    return first, last, row_of(first, offs), inside


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Byte start of each piece, its first word, whether it starts a sentence, its
    row, and the hashes of the words."""
    first, _, _, inside = sentences(raw, offs)
    starts, ends = runs(~SPACE[raw], offs)
    codes = span_hashes(raw, starts, ends)
    opens = np.zeros(len(starts), bool)
    heads = np.searchsorted(starts, first)
    opens[heads] = True
    cuts = opens.copy()
    if len(starts) >= WINDOW:
        place = np.arange(len(starts)) - np.repeat(heads, inside)
        size = np.repeat(inside, inside)
        free = (size > SHORT) & (place >= APART) & (size - place >= APART)
        mark = codes.copy()
        with np.errstate(over="ignore"):
            mark[1:] += codes[:-1] * (SEEDS[1] | U64(1))
        windows = np.lib.stride_tricks.sliding_window_view(mix(mark ^ SEEDS[2]), WINDOW)
        # a window lies in one sentence if its last place is as much further in
        ok = np.flatnonzero(free[:-WINDOW + 1] & free[WINDOW - 1:] & (place[WINDOW - 1:] - place[:-WINDOW + 1] == WINDOW - 1))
        cuts[ok + windows[ok].argmin(axis=1)] = True
    at = np.flatnonzero(cuts)
    return starts[at], at, opens[at], row_of(starts[at], offs), codes


def spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first unit, end unit, two hashes) of every span; units are numbered
    within their row."""
    _, first, _, row, codes = pieces(raw, offs)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64)
    words = np.append(first, len(codes))
    at = np.arange(len(first))
    end = np.maximum(at + UNITS, np.searchsorted(words, first + WORDS))
    at = at[end <= np.searchsorted(row, row, "right")]
    end = end[at]
    base = np.searchsorted(row, row[at])
    h1, h2 = (run_hashes(x, words[at], words[end]) for x in (codes, mix(codes ^ SEEDS[0])))
    return row[at], at - base, end - base, h1, h2


def later_ones(h1: np.ndarray, h2: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal hashes: the numbers of the first ones by ``place``, of the others, and of
    the first one of each of the others."""
    order = np.lexsort((*place[::-1], h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    heads = order[new]
    return heads, order[~new], heads[np.cumsum(new) - 1][~new]


def merged(owner: np.ndarray, source: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching intervals of one (owner, source) as one."""
    order = np.lexsort((first, source, owner))
    owner, source, first, end = owner[order], source[order], first[order], end[order]
    other = np.ones(len(order), bool)
    other[1:] = (owner[1:] != owner[:-1]) | (source[1:] != source[:-1])
    group = np.cumsum(other) << 32
    reach = np.maximum.accumulate(group + end) - group if len(order) else end  # furthest end so far in the group
    new = other.copy()
    new[1:] |= first[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)[:int(new.sum())]
    return owner[new], source[new], first[new], reach[last]


#: ``place`` is first << 32 | end, ``mark`` the second hash << 32 | body: 16 of a row's 32 bytes that travel don't compress
SPANS = "doc_id long, place long, h1 long, mark long, source long, open boolean"


def body_hash(name: str):
    return text_hash(name).bitwiseAND(F.lit((1 << 32) - 1))


def span_table(docs: DataFrame) -> DataFrame:
    """Spans of (doc_id, text, body) rows: ``open`` ones are the first in their task; the
    others are intervals covered by them, merged, with the doc_id of the first one."""

    def settled(held: list[tuple[np.ndarray, ...]]):
        doc, body, row, first, end, h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
        heads, rest, head = later_ones(h1, h2, doc, body, first)
        again = (doc[rest] == doc[head]) & (body[rest] == body[head]) & (first[rest] == first[head])  # the same row twice
        rest, head = rest[~again], head[~again]
        owner, source, a, b = merged(row[rest], doc[head], first[rest], end[rest])
        sample = np.zeros(int(row.max()) + 1, np.int64)
        sample[row] = np.arange(len(row))
        owner = sample[owner]
        n, m = len(heads), len(owner)
        place = np.concatenate([first[heads] << 32 | end[heads], a << 32 | b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([doc[heads], doc[owner]])), pa.array(place), pa.array(np.concatenate([h1[heads], np.zeros(m, np.int64)])),
             pa.array(np.concatenate([h2[heads] << 32 | body[heads], body[owner]])), pa.array(np.concatenate([doc[heads], source])), pa.array(np.arange(n + m) < n)],
            names=[c.split()[0] for c in SPANS.split(", ")])

    def run(batches):
        held, size, rows = [], 0, 0
        for batch in batches:
            docs_, bodies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for start, _, raw, offs in texts(batch.column(1)):
                row, first, end, h1, h2 = spans(raw, offs)
                if len(row):
                    held.append((docs_[start + row], bodies[start + row], rows + start + row, first, end, h1.view(np.int64), (h2 >> U64(32)).astype(np.int64)))
                    size += len(row)
                if size >= TOGETHER:
                    yield from settled(held)
                    held, size = [], 0
            rows += batch.num_rows
        if held:
            yield from settled(held)

    return docs.mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, first, end, source): units first to end of a document (``body`` is its
    ``body_hash``) that spans cover which the document ``source`` has earlier."""
    docs = (docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), body_hash(text).alias("body"))
            .filter("doc_id IS NOT NULL"))
    found = written(span_table(docs), "spans")

    def later(batches):
        kept = None  # the last one's hashes and the first of its kind
        for batch in batches:
            doc, place, h1, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(doc):
                continue
            h2, body, first = mark >> 32, mark & LOW, place >> 32
            new = np.ones(len(doc), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            goes_on = kept is not None and kept[:2] == (h1[0], h2[0])
            at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            heads = [np.where(at == 0, kept[k], x[at]) if goes_on else x[at] for k, x in ((2, doc), (3, body), (4, first))]
            kept = (h1[-1], h2[-1], heads[0][-1], heads[1][-1], heads[2][-1])
            rest = ~((doc == heads[0]) & (body == heads[1]) & (first == heads[2]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[rest]), pa.array(place[rest]), pa.array(body[rest]), pa.array(heads[0][rest])],
                                             names=["doc_id", "place", "mark", "source"])

    dealt = found.filter("open").select("doc_id", "place", "h1", "mark").repartition("h1")
    across = (dealt.sortWithinPartitions("h1", F.shiftright("mark", 32), "doc_id", "mark", "place")
              .mapInArrow(later, "doc_id long, place long, mark long, source long"))
    every = across.unionByName(found.filter("NOT open").select("doc_id", "place", "mark", "source"))
    return every.select("doc_id", F.col("mark").alias("body"), F.shiftright("place", 32).cast("int").alias("first"),
                        F.col("place").bitwiseAND(F.lit(LOW)).cast("int").alias("end"), "source")


def dedup_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the covered sentences cut from ``text`` (each up to the start of
    the next), and columns n_sentences, n_removed (sentences cut, whole or, of more than LONG
    words, in part), source_ids (documents that hold earlier occurrences); columns of
    these names in ``docs`` are replaced."""
    rest = docs.drop("n_sentences", "n_removed", "source_ids")
    own, body, cuts = fresh(rest, "_key"), fresh(rest, "_body"), fresh(rest, "_spans")
    hits = (repeated_spans(docs, key, text).groupBy("doc_id", "body")
            .agg(F.collect_set(F.struct("first", "end")).alias(cuts), F.array_sort(F.collect_set("source")).alias("source_ids"))
            .withColumnsRenamed({"doc_id": own, "body": body}))
    joined = (rest.join(hits, (quoted(key).cast("long") == F.col(own)) & (body_hash(text) == F.col(body)), "left")
              .select(*map(quoted, rest.columns), quoted(cuts), "source_ids"))
    at, where = rest.columns.index(text), len(rest.columns)

    def run(batches):
        for batch in batches:
            cleaned, counts, removed = [], [], []
            for t, cut in zip(batch.column(at).to_pylist(), batch.column(where).to_pylist(), strict=True):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                starts, heads, opens, _, codes = pieces(raw, np.array([0, len(raw)]))
                gone = np.zeros(len(starts) + 1, np.int64)
                for s in cut or []:
                    gone[min(s["first"], len(starts))] += 1
                    gone[min(s["end"], len(starts))] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                if gone.any():
                    sentence = np.cumsum(opens) - 1
                    words = np.bincount(sentence, np.diff(np.append(heads, len(codes))))
                    whole = np.bincount(sentence, ~gone) == 0
                    gone &= (whole | (words > LONG))[sentence]
                counts.append(int(opens.sum()))
                removed.append(len(np.unique(np.cumsum(opens)[gone])))
                if gone.any():
                    edges = np.append(starts, len(raw))
                    head = raw[:edges[0]].tobytes()
                    t = (head + b"".join(raw[a:b].tobytes() for a, b, g in zip(edges, edges[1:], gone, strict=False) if not g)).decode().rstrip()
                cleaned.append(t)
            columns = [pa.array(cleaned, pa.string()) if i == at else batch.column(i) for i in range(where)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column(where + 1)],
                names=[*batch.schema.names[:where], "n_sentences", "n_removed", "source_ids"])

    schema = T.StructType([*[T.StructField(f.name, T.StringType()) if f.name == text else f for f in rest.schema.fields],
                           T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("source_ids", T.ArrayType(T.LongType()))])
    return joined.mapInArrow(run, schema)
