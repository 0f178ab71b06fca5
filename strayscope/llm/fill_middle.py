"""Fill-in-the-middle rewriting of texts, cut at token boundaries.

A text is n tokens (a run of A-Z/a-z, or any other single code point), so it has
n + 1 boundaries.  They are kept as a compressed set of code point offsets
(:class:`BoundarySet`): per 65,536 offsets one container, a sorted array, a bitmap
or a list of runs, whichever is smallest, and the cumulative cardinalities.  The
k-th boundary is found by a search among these, then a select inside one container.

Spark sends each text to Python once and gets three numbers back; draws, output
and restoring are built-in functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayscope.llm.common import fresh, quoted

SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
REWRITTEN, SUFFIX_FIRST = 90, 20  # per cent of the texts, of the rewritten ones
CHUNK = 1 << 16
BITMAP_BYTES = CHUNK // 8


class BoundarySet:
    """Sorted set of offsets, filled in ascending order of chunks."""

    def __init__(self) -> None:
        self.bases: list[int] = []
        self.kinds: list[str] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.upto: list[int] = [0]  # cumulative cardinalities

    def __len__(self) -> int:
        return self.upto[-1]

    def append(self, base: int, member: np.ndarray) -> None:
        """The offsets ``base + i`` for which ``member[i]`` (at most CHUNK of them)."""
        low = np.flatnonzero(member).astype(np.uint16)
        if not len(low):
            return
        heads = np.concatenate(([0], np.flatnonzero(np.diff(low) != 1) + 1))
        size = {"array": 2 * len(low), "run": 4 * len(heads), "bitmap": BITMAP_BYTES}
        kind = min(size, key=size.get)
        if kind == "array":
            part = (low,)
        elif kind == "run":
            part = (low[heads], heads.astype(np.uint16))  # first offset, members before the run
        else:
            bits = np.zeros(CHUNK, bool)
            bits[:len(member)] = member
            part = (np.packbits(bits, bitorder="little").view(np.uint64),)
        self.bases.append(base)
        self.kinds.append(kind)
        self.parts.append(part)
        self.upto.append(self.upto[-1] + len(low))

    def select(self, k: int) -> int:
        """The member with ``k`` smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, "right")) - 1
        k, kind, part = k - self.upto[at], self.kinds[at], self.parts[at]
        if kind == "array":
            low = int(part[0][k])
        elif kind == "run":
            run = int(np.searchsorted(part[1], k, "right")) - 1
            low = int(part[0][run]) + k - int(part[1][run])
        else:
            filled = np.cumsum(np.bitwise_count(part[0]), dtype=np.int64)
            word = int(np.searchsorted(filled, k, "right"))
            bits = np.flatnonzero(np.unpackbits(part[0][word:word + 1].view(np.uint8), bitorder="little"))
            low = 64 * word + int(bits[k - (int(filled[word - 1]) if word else 0)])
        return self.bases[at] + low


def code_points(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(text: str) -> BoundarySet:
    """Offsets before, between and after the tokens of ``text``."""
    found, n = BoundarySet(), len(text)
    for base in range(0, n + 1, CHUNK):
        start = max(base - 1, 0)
        points = code_points(text[start:base + CHUNK])
        letter = ((points | 32) >= 97) & ((points | 32) <= 122)
        member = np.ones(min(CHUNK, n + 1 - base), bool)
        inner = letter[:-1] & letter[1:]  # offsets start + 1 and on
        first = start + 1 - base
        member[first:first + len(inner)] &= ~inner[:len(member) - first]
        found.append(base, member)
    return found


CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("tokens", "first", "second")])


@F.pandas_udf(CUTS)
def cuts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Number of tokens and the two cut offsets that a pair of draws gives."""
    for texts, draws, others in parts:
        rows = []
        for text, draw, other in zip(texts, draws, others):
            marks = boundaries(text)
            low, high = sorted((draw % len(marks), other % len(marks)))
            rows.append((len(marks) - 1, marks.select(low), marks.select(high)))
        yield pd.DataFrame(rows, columns=["tokens", "first", "second"])


def draw(key: Column, salt: str, k: int) -> Column:
    """Unsigned 32-bit number: the k-th 8-digit group of sha256(salt:key)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: str = "1",
                   rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    The draws come from the key alone, so repeated rows give repeated results and a
    lost task gives the same rows again; a null key reads as the empty string.  A
    null text is an empty one: n = 0, plain, empty output.  A text that holds a
    sentinel is plain.  An empty table gives an empty one, other columns of
    ``docs`` are left out.  A text is handled whole, in chunks of CHUNK code points."""
    name, t = fresh(docs, "_text"), F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(key).alias(key), t.alias(name),
                       *[draw(quoted(key), salt, k).alias(f"{name}{k}") for k in (1, 2, 3, 4)])
    rows = rows.withColumn(f"{name}cut", cuts(F.col(name), F.col(f"{name}1"), F.col(f"{name}2")))
    whole, first, second = F.col(name), F.col(f"{name}cut.first").cast("int"), F.col(f"{name}cut.second").cast("int")
    prefix, suffix = F.substr(whole, F.lit(1), first), F.substr(whole, second + 1)
    middle = F.substr(whole, first + 1, second - first)
    p, s, m = (F.lit(x) for x in SENTINELS)
    marked = F.contains(whole, p) | F.contains(whole, s) | F.contains(whole, m)
    form = (F.when((whole == "") | marked | (F.col(f"{name}3") % 100 >= rewritten), "plain")
            .when(F.col(f"{name}4") % 100 < suffix_first, "spm").otherwise("psm"))
    rows = rows.withColumn(f"{name}form", form)
    plain = F.col(f"{name}form") == "plain"
    return rows.select(
        quoted(key), F.col(f"{name}cut.tokens").alias("n"), F.col(f"{name}form").alias("form"),
        F.when(~plain, first.cast("long")).alias("prefix_chars"),
        F.when(~plain, (second - first).cast("long")).alias("middle_chars"),
        F.when(plain, whole).when(F.col(f"{name}form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
         .otherwise(F.concat(s, suffix, p, prefix, m, middle)).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from.  Rewritten texts hold no
    sentinel and none can arise at a joint, so each occurs once."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n, form, piece lengths and the digests of output and restored text."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
