"""Operator 8: token-id files with a minimal perfect hash index.

Payload: documents are dealt by ranges of their key, sorted, encoded, and each
task writes one shard file of raw ids (an 16-byte header, then unsigned 16- or
32-bit little-endian ids).  Index: keys are dealt by hash into buckets of about
``KEYS_PER_INDEX``; each bucket file holds a minimal perfect hash (levels of bit
arrays; a key's slot is the rank of its bit) and, for each slot, a 32-bit
fingerprint of the key with shard, position and length.  A lookup is one hash
per level, one rank and one comparison, whatever the number of keys.

Defined results: a null text is empty (only the end id is written); rows with a
null key come first and are read by position, as they can't be looked up; of
rows that repeat a key, the index holds the first, the others are read by
position too; an empty table gives no shards."""

from __future__ import annotations

import math
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strayscope.llm import shared_files
from strayscope.llm.common import LOWER, mix, row_of, runs, shared_path, span_hashes, texts, written

MAGIC = b"TOKENID1"
KEYS_PER_INDEX = 1 << 16
CACHE = 1_000_000  # words, of some 30 bytes
LONGEST_MARKS = 8  # marks that are cut off a word; a longer run stays with it
BLANK, MARK, PLAIN, ODD_FIRST = (np.zeros(256, bool) for _ in range(4))
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
MARK[list(b".,;:!?")] = True
PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
ODD_FIRST[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
CASED = "\u0130"  # below it, letters are composed and have one-letter lower cases
GAMMA = 1.5
LEVELS = 48
U64 = np.uint64
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u4")])
ENTRY = "doc_id long, shard int, file string, at long, n int, first boolean"


# --------------------------------------------------------------- tokenizer

class WordCache:
    """The library's encoding, word by word: this tokenizer drops white space and
    never joins across it, so the ids of a text are those of its words in order.

    Words are spans of bytes, known by 64 bits of hash.  Case is dropped, so A-Z are
    lower-cased first; marks behind a-z or 0-9 at the end of a word are a piece of their own and are
    looked up apart.  A word is encoded by the library when it first comes up; its ids
    lie in one long array, from which those of a text are gathered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        top = max(self.lib.get_vocab(with_added_tokens=True).values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.added = [t.content.lower().encode() for t in self.lib.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, U64), np.zeros(0, np.int32)  # of the known words, by hash
        self.ids, self.starts = np.zeros(1 << 16, self.dtype), np.zeros(1 << 16, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        found = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), self.dtype), np.array(list(map(len, found)), np.int64)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of plain lower-case letters: each is one pre-split piece, so
        all can be one text, cut again where the number of the piece changes."""
        coded = self.lib.encode(" ".join(words), add_special_tokens=False)
        piece = np.array(coded.word_ids)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(piece)]])
        return (np.array(coded.ids, self.dtype), np.diff(cuts)) if len(cuts) == len(words) + 1 else self._ids(words)

    def _learn(self, words: list[str], n: int) -> np.ndarray:
        """Appends the ids of ``words`` behind those of the ``n`` known ones; their numbers."""
        plain = np.array([w.isalpha() and (w.isascii() or max(w) < CASED) for w in words])
        numbers = np.empty(len(words), np.int32)
        for some, coder in ((np.flatnonzero(plain), self._letters), (np.flatnonzero(~plain), self._ids)):
            if not len(some):
                continue
            ids, lengths = coder([words[k].lower() for k in some] if coder == self._letters else [words[k] for k in some])
            end = int(self.starts[n])
            while end + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(some) >= len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.ids[end:end + len(ids)] = ids
            self.starts[n + 1:n + 1 + len(some)] = end + np.cumsum(lengths)
            numbers[some] = np.arange(n, n + len(some))
            n += len(some)
        return numbers

    def _pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words, marks at their ends cut off."""
        starts, ends = runs(~BLANK[data], offs)
        tail, k = np.zeros(len(starts), np.int64), np.arange(len(starts))
        for _ in range(LONGEST_MARKS):
            k = k[(ends[k] - tail[k] - 1 > starts[k]) & MARK[data[np.maximum(ends[k] - tail[k] - 1, 0)]]]
            tail[k] += 1
        tail[~PLAIN[data[np.maximum(ends - tail - 1, 0)]]] = 0
        cut = np.flatnonzero(tail)
        at = np.insert(starts, cut + 1, (ends - tail)[cut])
        return at, np.insert(ends, cut, (ends - tail)[cut])

    def _odd_places(self, raw: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of white space beyond ASCII, of the four separators that only some take for
        white space, and of added tokens in any case: texts that hold any go to the
        library whole."""
        at = np.flatnonzero(ODD_FIRST[raw])
        one, two = raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
        lead = raw[at]
        odd = (lead < 32) | (lead == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (lead == 0xE1) & (one == 0x9A) & (two == 0x80)
        odd |= (lead == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        odd |= (lead == 0xE2) & (one == 0x81) & (two == 0x9F) | (lead == 0xE3) & (one == 0x80) & (two == 0x80)
        found, text = [at[odd]], data.tobytes()
        for token in self.added:
            k = text.find(token)
            while k >= 0:
                found.append(np.array([k]))
                k = text.find(token, k + 1)
        return np.concatenate(found)

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each text of a slice (bytes, offsets)."""
        texts_ = len(offs) - 1
        data = LOWER[raw]
        odd = row_of(self._odd_places(raw, data), offs)
        whole = {r: self._ids([raw[offs[r]:offs[r + 1]].tobytes().decode()])[0] for r in np.unique(odd).tolist()}
        starts, ends = self._pieces(data, offs)
        if not len(starts):
            return [whole[r].tobytes() if r in whole else b"" for r in range(texts_)]
        hashes, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(hashes) > CACHE:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        own = np.empty(len(hashes), np.int32)
        own[~new] = self.numbers[at[~new]]
        if new.any():
            text, spans = data.tobytes(), zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            own[new] = self._learn([text[a:b].decode() for a, b in spans], len(self.hashes))
            self.hashes, self.numbers = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.numbers, at[new], own[new])
        own = own[back]
        counts = self.starts[own + 1] - self.starts[own]
        upto = np.concatenate([[0], np.cumsum(counts)])
        places = np.arange(upto[-1]) + np.repeat(self.starts[own] - upto[:-1], counts)
        flat, cuts = self.ids[places].tobytes(), (upto[np.searchsorted(starts, offs)] * self.dtype.itemsize).tolist()
        return [whole[r].tobytes() if r in whole else flat[cuts[r]:cuts[r + 1]] for r in range(texts_)]


_LOADED: dict[str, WordCache] = {}


def load(path: str) -> WordCache:
    if path not in _LOADED:
        _LOADED[path] = WordCache(path)
    return _LOADED[path]


# ------------------------------------------------------ minimal perfect hash

def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys that
    land alone on a bit are settled, the others go on to the next level; what
    is left after the last level is kept as a sorted list."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys.astype(U64)
        while len(left) and len(sizes) < LEVELS:
            size = math.ceil(GAMMA * len(left)) + 1
            at = _position(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; any number (or -1) for keys that were never added."""
        keys = keys.astype(U64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = _position(keys[open_], level, size) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.rank[-1] + at[found]
        return out

    def pack(self) -> bytes:
        return (struct.pack("<II", len(self.sizes), len(self.rest)) + np.array(self.sizes, "<u8").tobytes()
                + self.rest.astype("<u8").tobytes() + np.packbits(self.bits).tobytes())

    @classmethod
    def unpack(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes read."""
        levels, rest = struct.unpack_from("<II", raw)
        sizes = np.frombuffer(raw, "<u8", levels, 8).astype(np.int64)
        left = np.frombuffer(raw, "<u8", rest, 8 + 8 * levels)
        start, total = 8 + 8 * (levels + rest), int(sizes.sum())
        end = start + (total + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, end - start, start), count=total).astype(bool)
        return cls(sizes.tolist(), bits, left), end


class IndexFile:
    """Constant-time lookups in one bucket of the index."""

    def __init__(self, raw: bytes):
        self.hash, end = PerfectHash.unpack(raw)
        self.slots = np.frombuffer(raw, SLOT, offset=end)

    @staticmethod
    def pack(keys: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
        keys = keys.astype(np.int64).view(U64)
        hashed, slots = PerfectHash.build(keys), np.zeros(len(keys), SLOT)
        where = hashed.slots(keys)
        slots["print"][where], slots["shard"][where], slots["at"][where], slots["n"][where] = fingerprint(keys), shard, at, n
        return hashed.pack() + slots.tobytes()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, slot records) of the keys; the fingerprint turns strangers away."""
        keys = keys.astype(np.int64).view(U64)
        where = self.hash.slots(keys)
        records = self.slots[np.maximum(where, 0)] if len(self.slots) else np.zeros(len(keys), SLOT)
        return (where >= 0) & (records["print"] == fingerprint(keys)), records


# ------------------------------------------------------------------- spark

def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, key: str = "doc_id",
              text: str = "text", shards: int | None = None) -> DataFrame:
    """Write the shard files in ascending key order; return the written entries
    (doc_id, shard, file, at, n, first), ``at`` counted in ids within the shard."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        words, out, uri, at, before = load(path), None, None, 0, None
        shard, last = TaskContext.get().partitionId(), np.array([end_id], load(path).dtype).tobytes()
        for batch in batches:
            keys, lengths, firsts = batch.column(0).to_pylist(), [], []
            if out is None and keys:
                uri, out = shared_files.create(folder, f"shard-{shard:06d}", ".ids")
                out.write(MAGIC + struct.pack("<II", words.dtype.itemsize, 0))
            for _, _, raw, offs in texts(batch.column(1)):
                for ids in words.encode(raw, offs):
                    out.write(ids + last)
                    lengths.append(len(ids + last) // words.dtype.itemsize)
            for k in keys:
                firsts.append(k is not None and k != before)
                before = k
            n = np.array(lengths, np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shard] * len(n), pa.int32()), pa.array([uri] * len(n)),
                 pa.array(ends - n, pa.int64()), pa.array(n, pa.int32()), pa.array(firsts, pa.bool_())],
                names=["doc_id", "shard", "file", "at", "n", "first"])
            at = int(ends[-1]) if len(ends) else at
        if out is not None:
            out.close()

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    dealt = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(dealt.mapInArrow(run, ENTRY), "token-entries")


def shard_table(entries: DataFrame) -> DataFrame:
    """One row per shard: shard, file, base (ids in all shards before it)."""
    totals = entries.groupBy("shard").agg(F.first("file").alias("file"), F.sum("n").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return totals.select("shard", "file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def build_index(entries: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Write the index files; return their written list (bucket, index) and the
    number of buckets."""
    folder = folder or shared_path(entries.sparkSession, "token-index")
    keyed = entries.filter("first").select("doc_id", "shard", "at", "n")
    buckets = max(1, math.ceil(keyed.count() / KEYS_PER_INDEX))

    def run(group: pa.Table) -> pa.Table:
        cols = [group.column(c).to_numpy() for c in ("doc_id", "shard", "at", "n")]
        bucket = group.column("bucket")[0].as_py()
        uri, out = shared_files.create(folder, f"index-{bucket:06d}", ".mph")
        with out:
            out.write(IndexFile.pack(*cols))
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "index": [uri]})

    grouped = keyed.withColumn("bucket", _bucket("doc_id", buckets)).groupBy("bucket")
    return written(grouped.applyInArrow(run, "bucket int, index string"), "token-index-files"), buckets


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, shard, at, n) of the keys that the index holds.  Keys are streamed
    past their bucket's file, so a key that fills the table gathers nowhere."""

    def run(batches):
        name, found = None, None
        for batch in batches:
            files = batch.column(1).to_pylist()
            all_keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if files[a] != name:
                    name = files[a]
                    with shared_files.open_random(name) as f:
                        found = IndexFile(f.read())
                ok, at = found.find(all_keys[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(all_keys[a:b][ok], pa.int64()), pa.array(at["shard"][ok].astype(np.int32)),
                     pa.array(at["at"][ok].astype(np.int64)), pa.array(at["n"][ok].astype(np.int32))],
                    names=["doc_id", "shard", "at", "n"])

    named = (keys.filter(F.col("doc_id").isNotNull()).withColumn("bucket", _bucket("doc_id", buckets))
             .join(index, "bucket").select("doc_id", "index"))
    return named.sortWithinPartitions("index").mapInArrow(run, "doc_id long, shard int, at long, n int")


def read_ids(located: DataFrame, shards: DataFrame) -> DataFrame:
    """Read the listed stretches from the shard files: doc_id, start (over all
    shards), n_tokens, ids_crc32 (of the ids as unsigned 32-bit little-endian)."""

    def run(batches):
        name, handle, width = None, None, 0
        for batch in batches:
            crc, ids = [], batch.column(0)
            for uri, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if uri != name:
                    if handle is not None:
                        handle.close()
                    name, handle = uri, shared_files.open_random(uri)
                    head = handle.read_at(16, 0)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{uri} is no token-id file")
                    width = struct.unpack_from("<I", head, 8)[0]
                raw = handle.read_at(n * width, 16 + at * width)
                if len(raw) != n * width:
                    raise ValueError(f"{uri} ends before id {at + n}")
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([ids, batch.column(4), batch.column(3).cast(pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = (located.join(shards, "shard").select("doc_id", "file", "at", "n", (F.col("base") + F.col("at")).alias("start")))
    return rows.sortWithinPartitions("file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
                          shards: int | None = None) -> DataFrame:
    """Write ``docs`` as token-id shards with their index, then read every document
    back: by key through the index, the rest (null and repeated keys) by position."""
    entries = write_ids(docs, path, end_id, key=key, text=text, shards=shards)
    index, buckets = build_index(entries)
    keys = docs.select(docs[key].cast("long").alias("doc_id")).distinct()
    located = lookup(keys, index, buckets).unionByName(
        entries.filter("not first").select("doc_id", "shard", "at", "n"))
    return read_ids(located, shard_table(entries))
