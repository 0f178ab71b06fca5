"""Operator 4: BPE encoding and decoding by per-prefix dynamic programming.

A byte-level BPE whose every token is the result of its own merges has this
property: an encoding is the right one exactly when each pair of neighbours is,
and of all tokens that end at a given byte there is exactly one whose
predecessor is compatible.  So for each prefix of a piece of text we store that
last token: an Aho-Corasick automaton (the suffix automaton of the vocabulary)
lists the tokens that are suffixes of the prefix, and a pair test picks the one
that fits the last token of the shorter prefix.  Following the stored tokens
from the end gives the ids.

The tokenizer's own pre-split pattern and special-token strings are honoured.
Text is handled piece by piece with bounded caches; no text is cut short."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The published pre-split pattern of this byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 250_000


def byte_letters() -> dict[int, str]:
    """The one-letter spelling of each byte in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixBPE:
    """``encode(text) -> ids`` and ``decode(ids) -> text`` of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.letters = byte_letters()
        self.ascii = {b: c for b, c in self.letters.items() if b < 128}
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.specials.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(PATTERN)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # rank of a pair, and the pair each token was made of (first rank wins)
        self.rank, self.parts, self.made_at = {}, {}, {}
        for r, (a, b) in enumerate(pairs):
            key, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(key, r)
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = key, r
        self.auto = ahocorasick.Automaton()
        for s, i in vocab.items():
            if len(s) == 1 or i in self.parts:
                self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.size_of = {i: len(raw) for i, raw in self.bytes_of.items()}
        self.shift = max(self.bytes_of).bit_length()
        self.fits: dict[int, bool] = {}  # key: both ids in one number
        self.young: dict[str, bytes] = {}  # ids of pieces and chunks
        self.old: dict[str, bytes] = {}
        self.names = [str(i) for i in range(max(self.bytes_of) + 1)]
        self.sizes = np.array([self.size_of.get(i, 0) for i in range(len(self.names))], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Do ``a`` and ``b`` stay apart when their joined bytes are encoded?

        Merges run in rank order, so a token at the border lives from its own
        rank to the rank of the merge that takes it.  Undo the merges from the
        last one: a border pair whose rank lies before the end of both lives
        would have been merged.  At equal ranks the leftmost pair goes first."""
        left, right = a, b
        left_ends = right_ends = len(self.rank) + 1
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < left_ends and r <= right_ends:
                ok = False
                break
            l_at, r_at = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if l_at == r_at == -1:
                ok = True
                break
            if l_at > r_at:
                left_ends, left = l_at, self.parts[left][1]
            else:
                right_ends, right = r_at, self.parts[right][0]
        if len(self.fits) >= 3 * CACHE:
            self.fits.clear()
        self.fits[a << self.shift | b] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-split piece."""
        spelled = piece.translate(self.ascii) if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        last = [-1] * (len(spelled) + 1)  # the last token of each prefix
        fits, shift = self.fits, self.shift
        for end, (token, size) in self.auto.iter(spelled):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0:
                    last[end] = token
                elif (before := last[start]) >= 0:
                    ok = fits.get(before << shift | token)
                    if ok is None:
                        ok = self.compatible(before, token)
                    if ok:
                        last[end] = token
        out, at = [], len(spelled)
        while at:
            out.append(last[at])
            at -= self.size_of[last[at]]
        out.reverse()
        return out

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Ordinary stretches and (True) special-token strings, in order."""
        if self.special_split is None or not any(s in text for s in self.specials):
            yield text, False
            return
        for k, part in enumerate(self.special_split.split(text)):
            if part:
                yield part, bool(k % 2)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids) -> str:
        return self.decode_array(np.asarray(ids, np.int64))

    def _keep(self, key: str, ids: bytes) -> bytes:
        """Cache in two generations: when the young one is full, it replaces the old."""
        if len(key) <= 48:
            if len(self.young) >= CACHE:
                self.old = dict(self.young)
                self.young.clear()
            self.young[key] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        known = self.young.get(piece) or self.old.get(piece)
        return known or self._keep(piece, array("I", self.encode_piece(piece)).tobytes())

    def _chunk(self, chunk: str) -> bytes:
        known = self.old.get(chunk)
        if known is not None:
            return self._keep(chunk, known)
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._piece(chunk)
        parts = self.split.findall(chunk)
        return self._piece(chunk) if len(parts) == 1 else self._keep(chunk, b"".join(map(self._piece, parts)))

    def encode_array(self, text: str) -> np.ndarray:
        """Ids as an array.  No piece of the pattern has a space after anything but
        white space, so a text may be cut before any single space: the chunks
        repeat and are kept."""
        out = []
        for part, special in self.segments(text):
            if special:
                out.append(array("I", [self.specials[part]]).tobytes())
            elif SPACED.search(part):
                out += map(self._piece, self.split.findall(part))
            else:
                head, *rest = part.split(" ")
                get, miss = self.young.get, self._chunk
                out += [get(c) or miss(c) for c in ([head] if head else []) + [" " + w for w in rest]]
        return np.frombuffer(b"".join(out), np.uint32)

    def decode_array(self, ids: np.ndarray) -> str:
        """The text of an array of ids: their bytes laid end to end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.places[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the comma-joined ids, SHA-256 of the decoded text)."""
        ids = self.encode_array(text)
        joined = ",".join(map(self.names.__getitem__, ids.tolist()))
        return (len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(self.decode_array(ids).encode("utf-8")).hexdigest())


SPACED = re.compile(r"\s ")
_LOADED: dict[str, PrefixBPE] = {}


def load(path: str) -> PrefixBPE:
    """One tokenizer for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with columns ``ids`` (array<int>) and ``decoded`` added (columns of
    these names in ``docs`` are replaced).  Null text: no ids, decoded ''."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    rest = docs.select(*keep)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids])],
                names=[*batch.schema.names, "ids", "decoded"])

    from pyspark.sql import types as T
    schema = T.StructType([*rest.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])
    return rest.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.  Null text
    counts as empty; rows with null or repeated keys each keep their row."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            out = [bpe.digest(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                 pa.array([o[2] for o in out], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
