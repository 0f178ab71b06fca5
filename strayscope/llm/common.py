"""Shared helpers of the llm operators: session settings, written tables in the
shared folder, vectorised byte-level tokenising and hashing of Arrow texts.

Everything here works on UTF-8 bytes straight from the Arrow buffers, in
slices of about ``SLICE`` bytes, so that memory doesn't follow the batch size
(a single longer text is one slice).  Null texts read as empty."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayscope.session import configure_session, ensure_checkpoint_dir, ship_package

SLICE = 1 << 20
U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Runtime settings of the llm queries: AQE, small Arrow batches (a batch of
    long texts must fit beside the JVM heap), checkpoint folder, shipped package."""
    configure_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder, read it back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, kind)
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_hash(name: str) -> Column:
    """Tells rows with the same key but different texts apart."""
    return F.xxhash64(quoted(name).cast("string"))


def lean(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the worker gives freed memory back to the
    system: Spark keeps workers for later tasks, and what their arrays took with them."""

    def leave(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
            trim(0)

    return leave


# ------------------------------------------------------------ Arrow texts

def texts(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets of the rows in those bytes) of
    about ``size`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[off[first]:off[end]], off[first:end + 1] - off[first]
        first = end


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at the row offsets."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[offs] = True
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ---------------------------------------------------------------- hashing

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain) over an array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt << 20)) * U64(0x9E3779B97F4A7C15))


BYTE_CODE = seeds(256, 1)
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        n = max(n, SLICE + 1)
        up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``codes[start:end]``, from one running sum over all codes."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * up[:len(codes)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    return run_hashes(BYTE_CODE[data], starts, ends)


@lru_cache(maxsize=32)
def _weights(k: int) -> np.ndarray:
    return seeds(k, 2) | U64(1)


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``k`` consecutive items."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j, w in enumerate(_weights(k)):
            out += items[j:j + n] * w
    return mix(out)


def row_of(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Row index of each byte position (empty rows never own one)."""
    return np.searchsorted(offs, starts, "right") - 1


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, type=kind))


def bit_sketches(rows: np.ndarray, hashes: np.ndarray, n: int, longs: int, odd: bool) -> np.ndarray:
    """``n`` x ``longs`` words of bits, one bit for each hash of a row: set by any
    hash, or, if ``odd``, by an odd number of (distinct) ones."""
    wide = 64 * longs
    at = rows * wide + ((hashes >> U64(24)) % U64(wide)).astype(np.int64)
    if odd:
        at.sort()
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        at = at[heads[np.diff(heads, append=len(at)) % 2 == 1]]
    bits = np.zeros(n * wide, bool)
    bits[at] = True
    return np.packbits(bits).view(np.int64).reshape(n, longs)
