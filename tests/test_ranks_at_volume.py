"""Ranks over more rows than one range sample holds, with a payload column that
the counting branch doesn't need."""

from pyspark.sql import functions as F

from strayscope.operators import metrics


def test_global_row_number_is_a_permutation(spark, tmpdir_path):
    n = 500_000
    spark.range(0, n, 1, 12).select((F.xxhash64("id") % 1_000_003).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload")).write.parquet(tmpdir_path + "/rows")
    rows = spark.read.parquet(tmpdir_path + "/rows")
    got = metrics.global_row_number(rows, [F.col("k"), F.col("id")]).agg(
        F.countDistinct("rn").alias("d"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).first()
    assert (got["d"], got["lo"], got["hi"]) == (n, 1, n)
    numbered = metrics.global_row_number(rows.select("k", "id", "payload"), [F.col("k"), F.col("id")])
    wrong = numbered.alias("a").join(numbered.alias("b"), F.expr("b.rn = a.rn + 1")).filter("struct(b.k, b.id) < struct(a.k, a.id)").count()
    assert wrong == 0


def test_prefix_sums_end_at_the_total(spark, tmpdir_path):
    n = 300_000
    spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("s"), F.lit(1).alias("v"), F.repeat(F.lit("x"), 50).alias("payload")).write.parquet(tmpdir_path + "/sums")
    cum = metrics.descending_prefix_sums(spark.read.parquet(tmpdir_path + "/sums"), "s", ["v"])
    got = cum.agg(F.countDistinct("cum_v").alias("d"), F.max("cum_v").alias("hi"), F.count("payload").alias("p")).first()
    assert (got["d"], got["hi"], got["p"]) == (n, n, n)
