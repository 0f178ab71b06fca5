"""Likelihood ratio and word noise against a plain Python version."""

import bisect
import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strayscope.operators import likelihood as LR
from strayscope.operators import text as TO
from strayscope.operators.detectors import NotApplicable
from strayscope.sources import fixtures as FX
from tests.conftest import SF001


def uniform(digits, *parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:digits], 16) / 16 ** digits


def scores_by_hand(train, rows, noise, p=0.1):
    counts = Counter(w for _, words in train for w in words)
    vocab = sorted(counts, key=lambda w: (-counts[w], w))
    weights = [{"uniform": 1, "unigram": counts[w], "uniroot": math.floor(math.sqrt(counts[w]) * LR.ROOT_SCALE)}[noise] for w in vocab]
    ends = list(itertools.accumulate(weights))

    def noised(i, k, w):
        if uniform(8, 0, i, k, "noise") >= p:
            return w
        u = uniform(8 if noise == "uniform" else 13, 0, i, k, "word")
        return vocab[bisect.bisect_right(ends, math.floor(u * ends[-1]))]

    def model(texts):
        pairs, contexts = Counter(), Counter()
        for words in texts:
            for a, b in itertools.pairwise(["^", *words, "$"] if words else []):
                pairs[a, b] += 1
                contexts[a] += 1
        return lambda a, b: math.log((pairs[a, b] + 1) / (contexts[a] + len(vocab) + 5))

    inside, outside = model([w for _, w in train]), model([[noised(i, k, w) for k, w in enumerate(words)] for i, words in train])
    return {i: -sum(inside(a, b) - outside(a, b) for a, b in itertools.pairwise(["^", *words, "$"])) for i, words in rows if words}


@pytest.mark.parametrize("noise", LR.NOISE_TYPES)
def test_scores_of_each_noise(spark, noise):
    sp = FX.utterance_splits(spark, SF001)
    detector = LR.LikelihoodRatio(noise=noise, p_noise=0.3).fit(sp.train)
    got = {r["id"]: r["score"] for r in detector.score(sp.test).collect()}
    train = [(r["id"], r["toks"]) for r in detector.train.collect()]
    rows = [(r["id"], r["toks"]) for r in detector._tokens(sp.test).collect()]
    want = scores_by_hand(train, rows, noise, 0.3)
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[i] - want[i]) < 1e-7 for i in want)


def test_drawn_words_follow_the_weights(spark):
    counts = {"a": 1000, "b": 1000, "c": 100, **{f"r{k}": 1 for k in range(50)}}
    words = sorted(counts, key=lambda w: (-counts[w], w))
    vocab = spark.createDataFrame([(w, k + 5, counts[w]) for k, w in enumerate(words)], "word string, idx int, cnt long")
    r = random.Random(1)
    us = [0.0, 1 - 2 ** -52] + [r.random() for _ in range(2000)]
    draws = spark.createDataFrame(list(enumerate(us)), "n int, u double")
    for noise in LR.NOISE_TYPES:
        weights = [{"uniform": 1, "unigram": counts[w], "uniroot": math.floor(math.sqrt(counts[w]) * LR.ROOT_SCALE)}[noise] for w in words]
        ends = list(itertools.accumulate(weights))
        got = {x["n"]: x["word"] for x in LR.drawn_words(draws, vocab, noise).collect()}
        assert got == {n: words[bisect.bisect_right(ends, math.floor(u * ends[-1]))] for n, u in enumerate(us)}


def test_edges(spark):
    df = spark.createDataFrame([(1, "one two one", "a"), (2, "", "a"), (3, None, "a"), (4, "one two one", "a")], "id long, text string, intent string")
    detector = LR.LikelihoodRatio(noise="unigram", p_noise=1.0).fit(df)
    got = {r["id"]: r["score"] for r in detector.score(df.unionByName(df.withColumn("id", F.col("id") + 10).withColumn("text", F.lit("unheard")))).collect()}
    assert set(got) == {1, 4, 11, 12, 13, 14} and got[1] == got[4] and got[11] == got[12]
    counts = {(r["prev"], r["tok"]): (r["n_in"], r["n_bg"]) for r in LR.bigram_counts(detector.train, detector.vocab, "uniform", 0.0).collect()}
    assert counts == {(LR.BOS, "one"): (2, 2), ("one", "two"): (2, 2), ("two", "one"): (2, 2), ("one", LR.EOS): (2, 2)}
    with pytest.raises(NotApplicable):
        LR.LikelihoodRatio().fit(df.withColumn("intent", F.lit("oos")))
    with pytest.raises(ValueError):
        LR.LikelihoodRatio(noise="white")
    assert TO.SPECIALS[LR.TO.UNK_ID] == "[UNK]"


def test_changed_bigrams_need_no_place_and_no_group(spark):
    """Draws meet the few blocks of weights where they stand, and asked bigrams their counts in one exchange."""
    rows = [(i, ["a", "b", "c", "d"][i % 3:] + ["a"]) for i in range(60)]
    train = spark.createDataFrame(rows, "id long, toks array<string>").localCheckpoint()
    vocab = TO.vocab_build(train, F.col("toks")).localCheckpoint()
    asked = spark.createDataFrame([("a", "b"), ("x", "y"), ("a", "b")], "prev string, tok string")
    for noise in LR.NOISE_TYPES:
        counts = LR.bigram_counts(train, vocab, noise, 0.4, 3, asked)
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") <= 1 + plan.count("Aggregate [cnt")  # a single one over bigrams
        got = {(r["prev"], r["tok"]): r for r in counts.collect()}
        assert (got["x", "y"]["n_in"], got["x", "y"]["n_bg"], got["x", "y"]["asked"]) == (0, 0, True)
        assert got["a", "b"]["asked"] and got["a", "b"]["n_in"] == 20
        assert sum(r["n_in"] for r in got.values()) == sum(r["n_bg"] for r in got.values())
