"""Counting and drawing class subsets, against listing them."""

import random

import pytest

from strayscope.operators import splits as S


def listed(sizes, low, high):
    sums = S.subset_sums(sizes)
    return sorted((s, mask) for mask, s in enumerate(sums) if low <= s <= high)


@pytest.mark.parametrize("sizes, low, high", [
    ([random.Random(1).randrange(1, 40) for _ in range(16)], 60.5, 90),
    ([5] * 16, 20, 30), ([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], 700, 703.9), ([3], 0, 3), ([3, 0, 3], 3, 3), ([7, 9], 1, 2)])
def test_counts_and_ranks_equal_a_listing(spark, sizes, low, high):
    want = listed(sizes, low, high)
    table = S.SplitTable(spark, sizes, low, high)
    assert table.size == len(want)
    ranks = sorted({0, len(want) - 1, *(random.Random(2).randrange(max(1, len(want))) for _ in range(200))}) if want else []
    assert table.subsets(ranks) == [want[r][1] for r in ranks]


def test_wide_sums_are_searched_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 8)
    r = random.Random(3)
    sizes = [r.randrange(1, 5000) for _ in range(13)]
    want = listed(sizes, 9000, 21_000)
    table = S.SplitTable(spark, sizes, 9000, 21_000)
    ranks = [r.randrange(len(want)) for _ in range(40)]
    assert table.size == len(want) and table.subsets(ranks) == [want[k][1] for k in ranks]


def test_150_classes(spark):
    r = random.Random(4)
    sizes = [100] * 140 + [r.randrange(50, 200) for _ in range(10)]
    rows = spark.range(len(sizes)).selectExpr("concat('c', lpad(id, 3, '0')) AS intent", "id")
    df = rows.join(spark.createDataFrame(list(enumerate(sizes)), "id long, n int"), "id").selectExpr("intent", "explode(sequence(1, n)) AS i")
    got = S.draw_splits(df, 0.25, 5, seed=1).collect()
    ways = {0: 1}
    for n in sizes:
        more = dict(ways)
        for s, w in ways.items():
            more[s + n] = more.get(s + n, 0) + w
        ways = more
    total = sum(sizes)
    want = sum(w for s, w in ways.items() if 0.85 * 0.25 * total <= s <= 1.15 * 0.25 * total)
    assert want > 2 ** 100 and [x["n_subsets"] for x in got] == [str(want)] * 5 and len({tuple(x["classes"]) for x in got}) == 5
    for x in got:
        assert x["n_rows"] == sum(sizes[int(c[1:])] for c in x["classes"]) and 0.2125 * total <= x["n_rows"] <= 0.2875 * total
        assert sorted(x["classes"] + x["complement"]) == [f"c{k:03d}" for k in range(150)]
    assert got == S.draw_splits(df.repartition(5), 0.25, 5, seed=1).collect() != S.draw_splits(df, 0.25, 5, seed=2).collect()


def test_no_subset_no_rows(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10 + [(None,)] * 7, "intent string")
    assert S.draw_splits(df, 0.25).count() == 0 and S.draw_splits(df.filter("false"), 0.5).count() == 0
    half = S.draw_splits(df, 0.5, 5)
    assert sorted((x["draw"], x["n_rows"], x["n_subsets"]) for x in half.collect()) == [(0, 10, "2"), (1, 10, "2")]
    seen = S.split_versions(df, half).groupBy("version", "intent", "is_ood").count().collect()
    assert len(seen) == 6 and all(x["is_ood"] == 1 for x in seen if x["intent"] is None)
