"""Open-set class splits without listing them: the subsets of classes whose rows lie
within a band are counted, and any of them is found from its rank.

The counts are a table over (classes so far, row sum): a dynamic programme whose
levels are DataFrames of (row sum, number of subsets).  One level takes in a block of
classes by exploding each sum over the block's subset sums and adding up what meets,
so 150 classes are 19 levels, each with at most one row per reachable sum.  Numbers of
subsets pass 2^64, so they are columns of twelve decimal digits each.

A subset's rank is its place in the order of (row sum, mask), mask bit i standing for the
i-th class in lexical order.  To find the subset of a rank, its sum is searched for
by bucket totals, then the blocks are taken back one by one: the subsets of a block come
in the order of their bits, each in front of as many as the level below counts for the
sum that is left."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prep import SPLIT_TOLERANCE, class_counts

BLOCK = 8  # classes taken in at once: 256 subset sums a row
DIGITS = 12
BASE = 10 ** DIGITS
FAN = 4096  # buckets of one search step


def subset_sums(sizes: list[int]) -> list[int]:
    """Row sum of every subset, in the order of its bits."""
    sums = [0]
    for n in sizes:
        sums += [s + n for s in sums]
    return sums


class SplitTable:
    """Subsets of ``sizes`` (rows of each class) whose sum lies in [low, high]."""

    def __init__(self, spark: SparkSession, sizes: list[int], low: float, high: float):
        self.spark, self.sizes = spark, sizes
        self.low, self.high = max(0, math.ceil(low)), min(sum(sizes), math.floor(high))
        self.limbs = [f"n{k}" for k in range(int(len(sizes) * math.log10(2)) // DIGITS + 2)]
        self.blocks = [sizes[i:i + BLOCK] for i in range(0, len(sizes), BLOCK)]

    def _carried(self, level: DataFrame) -> DataFrame:
        """Brings every limb below BASE."""
        done, carry = [F.col("s")], F.lit(0).cast("long")
        for name in self.limbs:
            whole = F.col(name) + carry
            done.append(F.pmod(whole, F.lit(BASE)).alias(name))
            carry = F.call_function("div", whole, F.lit(BASE).cast("long"))
        return level.select(*done)

    @cached_property
    def levels(self) -> list[DataFrame]:
        """Level j: (s, limbs), the number of subsets of the first j blocks with sum s, of
        those sums that the other classes can still bring into the band."""
        from ..session import written
        fields = [T.StructField(c, T.LongType()) for c in ("s", *self.limbs)]
        first = self.spark.createDataFrame([(0, 1, *[0] * (len(self.limbs) - 1))], T.StructType(fields))
        found, rest = [first], sum(self.sizes)
        for block in self.blocks:
            rest -= sum(block)
            steps = F.array(*[F.struct(F.lit(s).cast("long").alias("add"), F.lit(n).cast("long").alias("times"))
                              for s, n in sorted(Counter(subset_sums(block)).items())])
            grown = found[-1].select(F.explode(steps).alias("z"), "*").select(
                (F.col("s") + F.col("z.add")).alias("s"), *[(F.col(c) * F.col("z.times")).alias(c) for c in self.limbs])
            grown = grown.filter((F.col("s") <= self.high) & (F.col("s") + rest >= self.low))
            grown = grown.groupBy("s").agg(*[F.sum(c).alias(c) for c in self.limbs])
            found.append(written(self._carried(grown), "split-level"))
        return found

    def _number(self, row) -> int:
        return sum(int(row[c]) * BASE ** k for k, c in enumerate(self.limbs))

    def _totals(self, width: int, within: set[int] | None = None) -> dict[int, int]:
        """Subsets by bucket of the sum (``width`` sums each), in the buckets of FAN times
        that width given; each bucket's limbs add up to at most FAN^2 * BASE."""
        last = self.levels[-1]
        if within is not None:
            last = last.filter(F.call_function("div", F.col("s"), F.lit(width * FAN).cast("long")).isin(*within))
        at = F.call_function("div", F.col("s"), F.lit(width).cast("long")).alias("at")
        digits = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in self.limbs]  # sums of many rows pass a long
        return {r["at"]: self._number(r) for r in last.groupBy(at).agg(*digits).collect()}

    @cached_property
    def width(self) -> int:
        """Width of the first buckets: at most FAN of them."""
        width = 1
        while self.high >= width * FAN:
            width *= FAN
        return width

    @cached_property
    def _first(self) -> dict[int, int]:
        return self._totals(self.width)

    @property
    def size(self) -> int:
        """Number of subsets in the band."""
        return sum(self._first.values())

    def _sums_at(self, ranks: list[int]) -> list[tuple[int, int]]:
        """(sum, rank among the subsets of that sum) of each rank."""
        def placed(totals: dict[int, int], keys: Iterable[int], rank: int) -> tuple[int, int]:
            for key in sorted(keys):
                if rank < totals[key]:
                    return key, rank
                rank -= totals[key]
            raise IndexError("rank beyond the number of subsets")

        width, at = self.width, [placed(self._first, self._first, r) for r in ranks]
        while width > 1:
            totals = self._totals(width // FAN, {key for key, _ in at})
            width //= FAN
            at = [placed(totals, [k for k in totals if k // FAN == key], r) for key, r in at]
        return at

    def subsets(self, ranks: list[int]) -> list[int]:
        """Masks of the subsets with these ranks."""
        if not ranks:
            return []
        state = [(s, r, 0) for s, r in self._sums_at(ranks)]
        for j in reversed(range(len(self.blocks))):
            sums = subset_sums(self.blocks[j])
            wanted = self.spark.createDataFrame([(x,) for x in sorted({s - b for s, _, _ in state for b in sums if b <= s})], "s long")
            ways = {r["s"]: self._number(r) for r in self.levels[j].join(wanted, "s").collect()}  # 256 a rank at most
            back = []
            for s, rank, mask in state:
                for bits, b in enumerate(sums):
                    here = ways.get(s - b, 0)
                    if rank < here:
                        back.append((s - b, rank, mask | bits << j * BLOCK))
                        break
                    rank -= here
            state = back
        return [mask for _, _, mask in state]


def drawn_ranks(size: int, n: int, seed: int) -> list[int]:
    """``n`` different ranks below ``size`` (all, if fewer): sha256(seed/j) modulo ``size``
    for j = 0, 1, ..., repeats skipped."""
    found: dict[int, None] = {}
    for j in count():
        if len(found) >= min(n, size):
            return list(found)
        found[int(hashlib.sha256(f"{seed}/{j}".encode()).hexdigest(), 16) % size] = None


def split_table(df: DataFrame, ratio: float, label: str = "intent", tolerance: float = SPLIT_TOLERANCE) -> tuple[list[str], SplitTable]:
    """(class names in lexical order, table) for the band ratio * rows * (1 +- tolerance).
    One row per class reaches the driver; rows without a class don't count."""
    counts = sorted((str(r[label]), int(r["n"])) for r in class_counts(df.filter(F.col(label).isNotNull()), label).collect())
    sizes = [n for _, n in counts]
    total = sum(sizes)
    return [c for c, _ in counts], SplitTable(df.sparkSession, sizes, (1 - tolerance) * ratio * total, (1 + tolerance) * ratio * total)


def draw_splits(df: DataFrame, ratio: float, n: int = 5, seed: int = 0, label: str = "intent",
                tolerance: float = SPLIT_TOLERANCE) -> DataFrame:
    """``n`` different class subsets of the band, drawn uniformly by ``seed``, for any number of
    classes: (draw, n_subsets decimal string, n_rows, classes, complement).  No subset in the
    band (an empty table too) gives no rows."""
    names, table = split_table(df, ratio, label, tolerance)
    size = table.size if names and table.low <= table.high else 0
    rows = []
    for k, mask in enumerate(table.subsets(drawn_ranks(size, n, seed)) if size else []):
        chosen = [i for i in range(len(names)) if mask >> i & 1]
        rows.append((k, str(size), sum(table.sizes[i] for i in chosen), [names[i] for i in chosen],
                     [c for i, c in enumerate(names) if not mask >> i & 1]))
    return df.sparkSession.createDataFrame(rows, "draw int, n_subsets string, n_rows long, classes array<string>, complement array<string>")


def split_versions(rows: DataFrame, splits: DataFrame, label: str = "intent") -> DataFrame:
    """``rows`` once for each of the drawn splits (a few: they become literals), with ``version``
    and ``is_ood`` (1 if the row's class is outside the split, or null)."""
    drawn = [(r["draw"], r["classes"]) for r in splits.select("draw", "classes").collect()]
    versions = [F.struct(F.lit(k).alias("version"), F.when(F.col(label).isin(*inside), 0).otherwise(1).alias("is_ood")) for k, inside in drawn]
    if not versions:
        return rows.withColumn("version", F.lit(0)).withColumn("is_ood", F.lit(1)).filter(F.lit(False))
    return rows.withColumn("_at", F.explode(F.array(*versions))).select(*rows.columns, "_at.version", "_at.is_ood")
