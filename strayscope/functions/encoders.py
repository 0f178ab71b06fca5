"""Pluggable text encoders as Arrow-batched pandas UDFs.

The user passes a zero-argument factory returning an object with
``encode(list[str]) -> array-like [n, d]``.  The encoder is built once per
Python worker (cached by factory), batches come from Arrow, and the result
is an ``array<float>`` column - the same shape as the precomputed
``embedding`` column the detectors consume.  Heavy model libraries are
optional and imported only inside the factory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CACHE: dict[int, object] = {}


def encoder_udf(factory: Callable[[], object], batch_size: int = 64):
    """Column function text -> array<float> using the user's encoder."""
    key = id(factory)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        enc = _CACHE.get(key)
        if enc is None:
            enc = _CACHE[key] = factory()
        out = []
        vals = texts.fillna("").tolist()
        for s in range(0, len(vals), batch_size):
            out.extend(np.asarray(enc.encode(vals[s:s + batch_size]), dtype=np.float32).tolist())
        return pd.Series(out)

    return encode


class HashingEncoder:
    """Dependency-free default encoder: signed feature hashing of lower-cased
    word tokens into ``dim`` buckets, L2-normalised (a stand-in when no model
    library is installed)."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode("utf-8"))
                out[i, h % self.dim] += 1.0 if (h >> 31) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def hashing_encoder_column(text: Column, dim: int = 64) -> Column:
    return encoder_udf(lambda: HashingEncoder(dim))(text)
