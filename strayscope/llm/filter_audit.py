"""Audit of how document filters interact: what each filter removes in every order.

Each document is reduced to a mask of the filters that it fails; documents with the
same (part, mask) are one weighted cell, at most 32 a part.  A higher-order fold takes
a cell through all orders: ``transform`` over the constant array of orders, ``aggregate``
along the five steps of each.  The 600 weighted structs of the cells of a part are then
added up element by element.  Only built-in functions.

Null texts read as empty.  Rows that repeat a document count as often as they occur,
a null doc_id has no labels and is never a copy (nor the first of copies); of several
label rows of one document any that says 1 counts.  An empty table gives no rows.  Other columns don't matter."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the five filters
FILTERS = "ABCDE"
FEWEST_WORDS = 200
DISTINCT_PER_CENT = 50
CAPITALS_PER_CENT = 3
ODD_SIGNS = "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    fails = (n < FEWEST_WORDS,
             100 * F.size(F.array_distinct(words)) < DISTINCT_PER_CENT * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITALS_PER_CENT * F.length(text).cast("long"),
             text.rlike(ODD_SIGNS))
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): number of documents, of quality 1 and of toxic 1 ones.

    A copy is a row whose text also has a smaller doc_id.  Rows of one (document, text)
    are counted before they move, and the smallest doc_id of a text is looked up by
    (text, doc_id), so neither a frequent text nor a frequent key meets in one task;
    rows without a key spread by text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).alias("low"))
            .groupBy("doc_id", "part", "same", "low").agg(F.count(F.lit(1)).alias("n")))
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("_id"))
    first = first.select(F.col("same").alias("_same"), "_id", F.lit(0).alias("_spread"), F.lit(True).alias("_first"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(F.lit(0))
    rows = rows.withColumn("_at", spread)
    rows = rows.join(first, (F.col("same") == F.col("_same")) & (F.col("doc_id") == F.col("_id")) & (F.col("_at") == F.col("_spread")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    rows = rows.select("doc_id", "_at", "part", "n", (F.col("low") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    rows = rows.join(known.withColumn("_spread", F.lit(0)), (F.col("doc_id") == F.col("_id")) & (F.col("_at") == F.col("_spread")), "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_good"), F.col("n")).otherwise(0)).alias("good"),
                                            F.sum(F.when(F.col("_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def all_orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def fold_orders(mask: Column, n: Column, good: Column, toxic: Column, orders: list[str]) -> Column:
    """Array of structs (order, step, filter, counts), one for each step of each order:
    what a cell of ``n`` documents with this ``mask`` adds to the counts."""
    kind = "array<struct<filter_order:string,step:int,filter:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    none = F.lit(0).cast("long")

    def along(order: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            letter = F.substring(order, k, F.lit(1))
            bit = F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
            fails, alive = mask.bitwiseAND(bit) != 0, acc["alive"]
            here = F.struct(
                order.alias("filter_order"), k.alias("step"), letter.alias("filter"),
                F.when(alive & ~fails, n).otherwise(none).alias("kept"), F.when(alive & fails, n).otherwise(none).alias("removed"),
                F.when(~alive & fails, n).otherwise(none).alias("redundant"), F.when(mask == bit, n).otherwise(none).alias("unique_fails"),
                F.when(alive & fails, good).otherwise(none).alias("good_lost"), F.when(alive & fails, toxic).otherwise(none).alias("toxic_lost"))
            return F.struct((alive & ~fails).alias("alive"), F.concat(acc["steps"], F.array(here)).cast(kind).alias("steps"))

        start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(1, len(orders[0]) + 1)]), start, step, lambda acc: acc["steps"])

    return F.flatten(F.transform(F.array(*[F.lit(o) for o in orders]), along))


def added(folds: Column) -> Column:
    """Element-wise sum of arrays that ``fold_orders`` made."""
    def both(x: Column, y: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("filter_order", "step", "filter")], *[(x[c] + y[c]).alias(c) for c in COUNTS])
    return F.aggregate(F.slice(folds, F.lit(2), F.size(folds)), folds[0], lambda acc, x: F.zip_with(acc, x, both))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, counts, shapley) for all 120 orders and 5 steps of every part;
    ``shapley`` is what the step's filter removes, summed over all orders."""
    cells = mask_cells(docs, labels, part)
    folds = cells.select("part", fold_orders(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), all_orders()).alias("steps"))
    summed = folds.groupBy("part").agg(added(F.collect_list("steps")).alias("steps"))  # at most 32 cells a part

    def share(letter: str) -> Column:
        return F.aggregate("steps", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["filter"] == letter, x["removed"]).otherwise(0))

    rows = summed.select("part", F.struct(*[share(f).alias(f) for f in FILTERS]).alias("share"), "steps")
    rows = rows.select("part", "share", F.explode("steps").alias("at"))
    shapley = F.coalesce(*[F.when(F.col("at.filter") == f, F.col(f"share.{f}")) for f in FILTERS])
    return rows.select("part", "at.filter_order", "at.step", *[f"at.{c}" for c in COUNTS], shapley.alias("shapley"))
