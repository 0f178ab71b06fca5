"""Data preparation: stratified folds, class weights, open-set class splits,
singleton duplication, feasibility filters, label indexing and seeded pair /
weighted sampling.

Per-class numbering never uses a window partitioned by class (one class may
hold a third of all rows): rows get a global rank in (class order, id) order
through range partitioning, and the class's start offset (a small per-class
table) turns it into the within-class rank.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import global_row_number
from .text import join_dimension, md5_uniform

# fixed values: logarithmic class-weight parameters and split tolerance
LOG_WEIGHT_MU = 0.35
LOG_WEIGHT_MIN = 0.65
SPLIT_TOLERANCE = 0.15
DIRECT_CLASSES = 20  # subsets of so many classes are one range
MASK_CLASSES = 62  # bits of a mask


def class_counts(df: DataFrame, label: str = "intent", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def class_table(df: DataFrame, label: str = "intent", id_col: str = "id", order: str = "first") -> DataFrame:
    """One row per class: n, first id, class order (``first`` appearance or
    ``lexical``) and start offset of the class block in that order."""
    t = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
    key = [F.col("first_id")] if order == "first" else [F.col(label)]
    w = Window.orderBy(*key)  # one row per class
    t = t.withColumn("cls_order", F.row_number().over(w) - 1)
    return t.withColumn("start", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def within_class_rank(df: DataFrame, classes: DataFrame, label: str = "intent", id_col: str = "id") -> DataFrame:
    """Adds ``g`` (0-based position in (class order, id) order) and ``r``
    (0-based rank inside the class)."""
    j = join_dimension(df, classes, label)
    ranked = global_row_number(j, [F.col("cls_order").asc(), F.col(id_col).asc()], "_rn")
    return ranked.withColumn("g", F.col("_rn") - 1).withColumn("r", F.col("_rn") - 1 - F.col("start")).drop("_rn")


def stratified_folds(df: DataFrame, n_splits: int = 5, label: str = "intent", id_col: str = "id") -> DataFrame:
    """(id, fold) following stratified k-fold without shuffling: classes in
    order of first appearance; positions of the label-sorted rows taken mod
    ``n_splits`` give per-fold quotas; each class fills folds in contiguous
    blocks in row (id) order."""
    classes = class_table(df, label, id_col, "first")
    ranked = within_class_rank(df.select(id_col, label), classes, label, id_col)
    S, n, r = F.col("start"), F.col("n"), F.col("r")

    def upto(m: Column, i: int) -> Column:  # #{0 <= x <= m : x = i mod K}
        return F.when(m >= i, F.floor((m - i) / n_splits) + 1).otherwise(F.lit(0))

    alloc = [upto(S + n - 1, i) - upto(S - 1, i) for i in range(n_splits)]
    cum, acc = [], None
    for a in alloc:
        acc = a if acc is None else acc + a
        cum.append(acc)
    fold = sum(F.when(c <= r, 1).otherwise(0) for c in cum)
    return ranked.select(id_col, fold.cast("int").alias("fold"))


def class_weights(df: DataFrame, label: str = "intent", mu: float = LOG_WEIGHT_MU,
                  min_value: float = LOG_WEIGHT_MIN) -> DataFrame:
    """(label, n, w_balanced = n/(k*n_c), w_log = max(ln(mu*n/n_c), min_value))."""
    c = class_counts(df, label)
    tot = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).first()
    total, k = int(tot["total"]), int(tot["k"])
    return c.select(label, "n", (F.lit(float(total)) / (F.lit(k) * F.col("n"))).alias("w_balanced"),
                    F.greatest(F.log(F.lit(mu * total) / F.col("n")), F.lit(min_value)).alias("w_log"))


def duplicate_singletons(df: DataFrame, label: str = "intent") -> DataFrame:
    """Rows of classes with a single row appear twice (so every class can be stratified)."""
    singles = class_counts(df, label).filter(F.col("n") == 1).select(label)
    return df.unionByName(join_dimension(df, singles, label, "left_semi"))


def open_set_splits(df: DataFrame, ratio: float, label: str = "intent",
                    tolerance: float = SPLIT_TOLERANCE) -> DataFrame:
    """All class subsets whose row count lies within ratio*n*(1 +- tolerance).

    Subsets are bitmasks over the lexically ordered classes; the row count of a
    mask is a sum of per-class counts selected by its bits, so the subsets of the
    20 largest classes are a ``range`` with one arithmetic column - no join.
    Further classes are put in or left out one by one; a subset that has too many
    rows, or can't reach enough with the classes to come, is not carried on.
    Above 62 classes the subsets in question are too many to list.
    Returns (mask, n_rows, classes, complement) with comma-joined class lists."""
    # at most MASK_CLASSES + 1 class rows ever reach the driver
    counts = sorted((r[label], int(r["n"])) for r in class_counts(df, label).limit(MASK_CLASSES + 1).collect())
    C = len(counts)
    if C > MASK_CLASSES:
        raise ValueError(f"more than {MASK_CLASSES} classes: a mask has {MASK_CLASSES} bits")
    total = sum(n for _, n in counts)
    lo, hi = (1 - tolerance) * ratio * total, (1 + tolerance) * ratio * total
    spark = df.sparkSession
    by_size = sorted(range(C), key=lambda i: (-counts[i][1], i))
    head, tail = sorted(by_size[:DIRECT_CLASSES]), by_size[DIRECT_CLASSES:]
    small = [F.shiftright(F.col("id"), k).bitwiseAND(1) for k in range(len(head))]
    mask = sum((F.shiftleft(b, i) for b, i in zip(small, head)), F.lit(0).cast("long"))
    n_rows = sum((b * counts[i][1] for b, i in zip(small, head)), F.lit(0).cast("long"))
    open_rows = sum(counts[i][1] for i in tail)
    out = spark.range(0, 1 << len(head)).select(mask.alias("mask"), n_rows.alias("n_rows"))
    for i in tail:
        out = out.filter((F.col("n_rows") <= hi) & (F.col("n_rows") + open_rows >= lo))
        out = out.select("mask", "n_rows", F.explode(F.array(F.lit(0), F.lit(1))).alias("in")).select(
            (F.col("mask") + F.col("in") * F.lit(1 << i).cast("long")).alias("mask"),
            (F.col("n_rows") + F.col("in") * F.lit(counts[i][1]).cast("long")).alias("n_rows"))
        open_rows -= counts[i][1]
    bits = [F.shiftright("mask", i).bitwiseAND(1) for i in range(C)]
    chosen = F.concat_ws(",", *[F.when(b == 1, F.lit(c)) for b, (c, _) in zip(bits, counts)])
    other = F.concat_ws(",", *[F.when(b == 0, F.lit(c)) for b, (c, _) in zip(bits, counts)])
    out = out.filter((F.col("n_rows") >= lo) & (F.col("n_rows") <= hi))
    return out.select("mask", "n_rows", chosen.alias("classes"), other.alias("complement"))


def pick_splits(splits: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n qualifying subsets in a seeded pseudo-random order (sampling; the limit is the feature)."""
    return splits.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col("mask").cast("string"))), "mask").limit(n)


def complement_classes(subset: Column, universe: Column) -> Column:
    return F.array_except(universe, subset)


def feasible_filter(val: DataFrame, train: DataFrame, label: str = "intent") -> DataFrame:
    """Validation rows whose label occurs in training."""
    return join_dimension(val, train.select(label).distinct(), label, "left_semi")


def mark_in_domain(df: DataFrame, classes: list[str], label: str = "intent") -> DataFrame:
    return df.withColumn("is_ood", F.when(F.col(label).isin(*classes), 0).otherwise(1))


def label_index(df: DataFrame, train: DataFrame, label: str = "intent", order: str = "lexical") -> DataFrame:
    """(id, label_idx): lexical (or first-appearance) class index from train; unseen -> -1."""
    classes = class_table(train, label, "id", order).select(label, "cls_order")
    j = join_dimension(df.select("id", label), classes, label, "left")
    return j.select("id", F.coalesce(F.col("cls_order"), F.lit(-1)).cast("int").alias("label_idx"))


def sample_pairs(df: DataFrame, label: str = "intent", seed: int = 0) -> DataFrame:
    """Per row one positive partner (same class, may be itself, target 1.0)
    and one negative partner (other class, target 0.0), md5-seeded:
    (id, partner_id, target)."""
    classes = class_table(df, label, "id", "lexical")
    total = int(classes.agg(F.sum("n")).first()[0])
    ranked = within_class_rank(df.select("id", label), classes, label, "id").cache()
    u_pos = md5_uniform(F.lit(seed), F.col("id"), F.lit("pos"))
    u_neg = md5_uniform(F.lit(seed), F.col("id"), F.lit("neg"))
    pos_g = F.col("start") + F.floor(u_pos * F.col("n")).cast("long")
    rest = F.lit(total) - F.col("n")
    j = F.floor(u_neg * rest).cast("long")
    neg_g = F.when(rest > 0, F.when(j >= F.col("start"), j + F.col("n")).otherwise(j))
    want = ranked.select("id", pos_g.alias("pos_g"), neg_g.alias("neg_g"))
    lookup = ranked.select(F.col("g").alias("pg"), F.col("id").alias("partner_id"))
    pos = want.join(lookup, want.pos_g == lookup.pg).select("id", "partner_id", F.lit(1.0).alias("target"))
    neg = want.join(lookup, want.neg_g == lookup.pg).select("id", "partner_id", F.lit(0.0).alias("target"))
    return pos.unionByName(neg)


def weighted_sample(df: DataFrame, n_draws: int | None = None, label: str = "intent", seed: int = 0) -> DataFrame:
    """Draws with replacement, each class equally likely (weight 1/class
    count per row): (draw, id)."""
    spark = df.sparkSession
    classes = class_table(df, label, "id", "lexical")
    meta = classes.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).first()
    k, total = int(meta["k"]), int(meta["total"])
    n_draws = total if n_draws is None else n_draws
    ranked = within_class_rank(df.select("id", label), classes, label, "id")
    draws = spark.range(0, n_draws).select(F.col("id").alias("draw"))
    draws = draws.select("draw", F.floor(md5_uniform(F.lit(seed), F.col("draw"), F.lit("class")) * k)
                         .cast("int").alias("cls_order"),
                         md5_uniform(F.lit(seed), F.col("draw"), F.lit("row")).alias("u"))
    d = join_dimension(draws, classes.select("cls_order", "start", "n"), "cls_order")
    d = d.select("draw", (F.col("start") + F.floor(F.col("u") * F.col("n")).cast("long")).alias("g"))
    return d.join(ranked.select("g", "id"), "g").select("draw", "id")


def dataset_sizes(df: DataFrame, ood_label: str, label: str = "intent") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == ood_label).alias("n_ood"),
                  F.count_if(F.col(label) != ood_label).alias("n_indomain"))
