"""Operator 9: language of each word by a linear-chain conditional random field.

Words are runs of letters.  A word's potential for each language is the sum of
learned weights of its prefixes and suffixes (1 to 3 bytes), its three-byte
n-grams with word boundaries and its entry in a lexicon of frequent training
words; learned transition weights link neighbours.  Forward-backward gives each
word's probabilities, so that code-switched text gets its languages word by
word; a document's language is the one with the largest sum of probabilities.

The model is fitted in one task from a bounded sample: at most
``TRAIN_DOCS`` labelled documents of each language (smallest hashes), at most
``TRAIN_WORDS`` words of each (of a long text, from a piece of 8 * ``TRAIN_WORDS``
characters at a place that its hash picks), and at most ``MAX_LABELS`` languages (more are an
error: none is left out unsaid); half of the training sequences join pieces of two
documents, so that transitions are learned from switches too.  Prediction reads
whole texts.  Defined results: a text that is null or has no letter is ``und`` with
score 0; so is every text if there is no labelled one; rows with null or repeated
keys each get their prediction; an empty table stays empty."""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayscope.llm.common import LOWER, U64, fresh, lean, mix, quoted, row_of, runs, seeds, span_hashes, texts

TRAIN_DOCS = 160
TRAIN_WORDS = 320
MAX_LABELS = 200
GRAM_BITS, AFFIX_BITS, LEXICON_MIN = 15, 14, 3
SEQUENCE, BATCH, EPOCHS, RATE = 32, 64, 3, 0.3
AT_ONCE = 1 << 19  # bytes of text whose arrays a task holds at a time
RESCALE = 4  # steps between two scalings to sum 1 (labels never all underflow in so few)
SEEDS = seeds(8, 9)
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True
UNKNOWN = "und"


# ----------------------------------------------------------------- features

class Words:
    """The words of a slice of texts with their feature numbers."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        data = LOWER[raw]
        letter = LETTER[data]
        self.starts, self.ends = runs(letter, offs)
        self.row = row_of(self.starts, offs)
        self.counts = np.bincount(self.row, minlength=len(offs) - 1)
        self.hashes = span_hashes(data, self.starts, self.ends)
        inside = np.where(letter, data, 32).astype(np.uint32)
        padded = np.concatenate([[32], inside, [32]]).astype(np.uint32)
        # three bytes around each letter of a word; spaces stand for the boundaries
        self.sizes = self.ends - self.starts
        places = np.flatnonzero(letter)
        first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        first[self.starts] = True
        last[self.ends - 1] = True
        before = np.where(first[places], 32, padded[places])
        after = np.where(last[places], 32, padded[places + 2])
        self.grams = _slot((before << 16) | (padded[places + 1] << 8) | after, SEEDS[0], GRAM_BITS)
        affixes = []
        for k in (1, 2, 3):
            reach = np.minimum(self.sizes, k)
            for side, (a, b) in enumerate(((self.starts, self.starts + reach), (self.ends - reach, self.ends))):
                code = np.full(len(a), 2 * k + side, np.uint32)
                for j in range(k):
                    code = code * np.uint32(257) + np.where(a + j < b, inside[np.minimum(a + j, b - 1)], 256).astype(np.uint32)
                affixes.append(_slot(code, SEEDS[1], AFFIX_BITS))
        self.affixes = np.stack(affixes, axis=1) if len(self.starts) else np.zeros((0, 6), np.int64)


def _slot(code: np.ndarray, seed, bits: int) -> np.ndarray:
    return (mix(code.astype(U64) ^ seed) >> U64(64 - bits)).astype(np.int64)


def lexicon_places(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted lexicon; its length for other words."""
    if not len(lexicon):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, len(lexicon))


class Model:
    """Weights; ``labels`` are the learned languages."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.gram, self.affix = np.zeros((1 << GRAM_BITS, n), np.float32), np.zeros((1 << AFFIX_BITS, n), np.float32)
        self.word = np.zeros((len(lexicon) + 1, n), np.float32)  # the last: not in the lexicon
        self.step = np.zeros((n, n))
        self.start = np.zeros(n)

    def potentials(self, words: Words) -> np.ndarray:
        """Words x labels."""
        if not len(words.starts):
            return np.zeros((0, len(self.labels)))
        at = np.cumsum(words.sizes) - words.sizes
        out = np.add.reduceat(self.gram[words.grams], at, axis=0)
        for j in range(words.affixes.shape[1]):
            out += self.affix[words.affixes[:, j]]
        return (out + self.word[lexicon_places(self.lexicon, words.hashes)]).astype(np.float64)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray, expect: bool = False):
    """Label probabilities of each word (and expected transitions, for training) of
    sequences laid end to end; in groups of similar length, padded within a group."""
    n = scores.shape[1]
    out, moves = np.zeros_like(scores), np.zeros((n, n))
    ends = np.cumsum(sizes)
    change = np.exp(step - step.max())
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        longest = max(2 * int(sizes[order[at]]), 32)
        stop = at + int(np.searchsorted(sizes[order[at:]], longest, "right"))
        own = order[at:stop][::-1]  # the longest first: the open sequences are a head of the list
        at = stop
        length = sizes[own]
        t_max, m = int(length[0]), len(own)
        index = np.minimum((ends - sizes)[own][None, :] + np.arange(t_max)[:, None], len(scores) - 1)
        local = scores[index]  # steps x sequences x labels
        local = np.exp(local - local.max(axis=2, keepdims=True))
        open_ = (length[None, :] > np.arange(t_max)[:, None]).sum(axis=1)
        ahead = np.empty((t_max, m, n))
        a = local[0] * np.exp(start - start.max())
        ahead[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, t_max):
            k = open_[t]
            a = np.multiply(ahead[t - 1, :k] @ change, local[t, :k], out=ahead[t, :k])
            if t % RESCALE == 0:
                a /= a.sum(axis=1, keepdims=True)
        behind, joint = np.ones((m, n)), np.empty((t_max, m, n))
        for t in range(t_max - 1, -1, -1):
            k = open_[t]
            np.multiply(ahead[t, :k], behind[:k], out=joint[t, :k])
            if t:
                back = local[t, :k] * behind[:k]
                if expect:
                    pair = (ahead[t - 1, :k, :, None] * change) * back[:, None, :]
                    moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = back @ change.T
                behind[:k] = back / back.sum(axis=1, keepdims=True) if t % RESCALE == 0 else back
        alive = np.arange(m)[None, :] < open_[:, None]
        p = joint[alive]
        out[index[alive]] = p / p.sum(axis=1, keepdims=True)
    return out, moves


# ----------------------------------------------------------------- training

def fit(samples: list[tuple[str, str]]) -> Model | None:
    """Fit on (text, label) pairs by stochastic gradients of the likelihood."""
    labels = sorted({y for _, y in samples})
    if not labels:
        return None
    pieces = []  # (label, feature rows) of at most SEQUENCE words
    every = [Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t, _ in samples]
    seen, counts = np.unique(np.concatenate([w.hashes[:TRAIN_WORDS] for w in every]), return_counts=True)
    model = Model(labels, seen[counts >= LEXICON_MIN])
    for w, (_, y) in zip(every, samples, strict=True):
        grams = np.split(w.grams, np.cumsum(w.sizes)[:-1]) if len(w.starts) else []
        place = lexicon_places(model.lexicon, w.hashes)
        for a in range(0, min(len(grams), TRAIN_WORDS), SEQUENCE):
            b = min(a + SEQUENCE, len(grams), TRAIN_WORDS)
            pieces.append((labels.index(y), grams[a:b], w.affixes[a:b], place[a:b]))
    random = np.random.default_rng(7)
    squares = [np.full(x.shape, 1e-4) for x in (model.gram, model.affix, model.word, model.step, model.start)]

    def update(k: int, table: np.ndarray, grad: np.ndarray) -> None:
        squares[k] += grad * grad
        table += (RATE * grad / np.sqrt(squares[k])).astype(table.dtype)

    for _ in range(EPOCHS):
        order, other = random.permutation(len(pieces)), random.permutation(len(pieces))
        for a in range(0, len(order), BATCH):
            grams, affixes, places, truth, sizes = [], [], [], [], []
            for i, j in zip(order[a:a + BATCH].tolist(), other[a:a + BATCH].tolist(), strict=True):
                parts = [pieces[i]]
                if i % 2:  # a switch: the head of one piece, then the tail of another
                    cut = int(random.integers(1, SEQUENCE))
                    parts = [tuple(x if k == 0 else x[:cut] for k, x in enumerate(pieces[i])),
                             tuple(x if k == 0 else x[cut:] for k, x in enumerate(pieces[j]))]
                for y, g, f, w in parts:
                    grams += g
                    affixes.append(f)
                    places.append(w)
                    truth += [y] * len(g)
                sizes.append(sum(len(p[1]) for p in parts))
            if not grams:
                continue
            affix, place, y, size = np.concatenate(affixes), np.concatenate(places), np.array(truth), np.array(sizes)
            flat, lengths = np.concatenate(grams), np.array([len(g) for g in grams])
            scores = np.add.reduceat(model.gram[flat], np.cumsum(lengths) - lengths, axis=0) + model.word[place]
            for j in range(affix.shape[1]):
                scores = scores + model.affix[affix[:, j]]
            p, moves = forward_backward(scores.astype(np.float64), size, model.step, model.start, expect=True)
            miss = -p
            miss[np.arange(len(y)), y] += 1
            grad = np.zeros_like(model.gram, np.float64)
            np.add.at(grad, flat, np.repeat(miss, lengths, axis=0))
            update(0, model.gram, grad)
            grad = np.zeros_like(model.affix, np.float64)
            np.add.at(grad, affix.ravel(), np.repeat(miss, affix.shape[1], axis=0))
            update(1, model.affix, grad)
            grad = np.zeros_like(model.word, np.float64)
            np.add.at(grad, place, miss)
            update(2, model.word, grad)
            heads = np.cumsum(size) - size
            follows = np.ones(len(y), bool)
            follows[heads[size > 0]] = False
            seen_moves = np.zeros_like(moves)
            np.add.at(seen_moves, (y[:-1][follows[1:]], y[1:][follows[1:]]), 1)
            update(3, model.step, seen_moves - moves)
            update(4, model.start, miss[heads[size > 0]].sum(axis=0))
    return model


def training_pieces(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame | None:
    """(y, h, t) of at most ``TRAIN_DOCS`` labelled texts per language, of ``MAX_LABELS`` languages
    at most: keys first, then their texts.  Of a text longer than 8 * ``TRAIN_WORDS`` characters, a
    piece of that length at a place that the hash of the row picks."""
    rows = docs.select(F.xxhash64(docs[key], docs[text]).alias("h"), docs[text].alias("t"), docs[lang].cast("string").alias("y")).filter("t IS NOT NULL AND y IS NOT NULL")
    labels = [r["y"] for r in rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages in {lang}: the field is fitted in one task and can't learn them all")
    if not labels:
        return None
    chosen = reduce(DataFrame.unionByName, [rows.filter(F.col("y") == y).select("y", "h").distinct().orderBy("h").limit(TRAIN_DOCS) for y in labels])
    texts_ = rows.join(F.broadcast(chosen), ["y", "h"]).dropDuplicates(["y", "h"])
    size = 8 * TRAIN_WORDS
    start = 1 + F.pmod(F.col("h"), F.greatest(F.length("t") - size, F.lit(0)) + 1)
    return texts_.select("y", "h", F.substr("t", start.cast("int"), F.lit(size)).alias("t"))


def training_sample(docs: DataFrame, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """The (text, label) pairs of ``training_pieces``."""
    found = training_pieces(docs, key, text, lang)
    return [] if found is None else [(r["t"], r["y"]) for r in found.orderBy("y", "h").collect()]


def fit_in_task(sample: DataFrame | None) -> Model | None:
    """The field fitted on the (bounded) sample, in a task of its own; only the model
    comes to the driver, in parts."""
    if sample is None:
        return None

    def run(batches):
        rows = sorted((r["y"], r["h"], r["t"]) for b in batches for r in b.to_pylist())
        raw = pickle.dumps(fit([(t, y) for y, _, t in rows]))
        for k in range(0, len(raw), 1 << 20):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "part": pa.array([raw[k:k + (1 << 20)]], pa.binary())})

    parts = sample.repartition(1).mapInArrow(lean(run), "k long, part binary").collect()
    return pickle.loads(b"".join(bytes(r["part"]) for r in sorted(parts, key=lambda r: r["k"]))) if parts else None


# --------------------------------------------------------------- prediction

def predict_texts(model: Model | None, column: pa.Array, certainty: bool = False) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the mean over its words of the probability of
    that language, or, for ``certainty``, of each word's likeliest language."""
    names, scores = [], []
    for first, end, raw, offs in texts(column, AT_ONCE):
        n = end - first
        words = Words(raw, offs)
        share = np.zeros((n, len(model.labels) if model else 1))
        sure = np.zeros(n)
        if model and len(words.starts):
            p, _ = forward_backward(model.potentials(words), words.counts, model.step, model.start)
            np.add.at(share, words.row, p)
            share /= np.maximum(words.counts, 1)[:, None]
            sure = np.bincount(words.row, p.max(axis=1), n) / np.maximum(words.counts, 1)
        # texts without an ASCII letter: is there any other letter?
        plain = np.zeros(n, bool)
        plain[words.row[(raw[words.starts] < 0x80) | (raw[words.ends - 1] < 0x80)]] = True
        some = np.array([bool(plain[i]) or bool(words.counts[i]) and any(map(str.isalpha, column[first + i].as_py() or "")) for i in range(n)], bool)
        best = share.argmax(axis=1)
        names += [model.labels[b] if model and ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
        scores.append(np.where(some & (model is not None), sure if certainty else share[np.arange(n), best], 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", name: str = "lang_pred", score: str = "score", certainty: bool = False) -> DataFrame:
    """``docs`` with the predicted language and its score, see ``predict_texts`` (columns of these names are replaced)."""
    rest = docs.drop(name, score)
    at = rest.columns.index(text)
    shared = rest.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches):
        for batch in batches:
            names, scores = predict_texts(shared.value, batch.column(at), certainty)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(np.minimum(scores, 1.0), pa.float64())],
                                             names=[*batch.schema.names, name, score])

    return rest.mapInArrow(lean(run), T.StructType([*rest.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))


def tag_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    p, _ = forward_backward(model.potentials(words), words.counts, model.step, model.start)
    return [(raw[a:b].tobytes().decode(), model.labels[int(q.argmax())], float(q.max())) for a, b, q in zip(words.starts, words.ends, p, strict=True)]


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def train_on(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    return fit_in_task(training_pieces(docs, key, text, lang))


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; fitted on rows that aren't held out."""
    model = train_on(docs.filter(~F.coalesce(held_out("doc_id"), F.lit(False))))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.35, text: str = "text") -> DataFrame:
    """``docs`` without those in no known language: ``und``, or words whose likeliest
    languages have a mean probability below ``least`` (whatever these languages are, so
    that text in several of them stays)."""
    name, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = with_language(docs, model, text, name, score, certainty=True)
    return found.filter((F.col(name) != UNKNOWN) & (F.col(score) >= least)).select(*map(quoted, docs.columns))
