"""Sub-word vectors against a dense decomposition; enhanced keywords."""

import random
from collections import Counter

import numpy as np

from strayscope.operators import subwords as SW
from strayscope.operators import text as TO


def corpus(n=150):
    r = random.Random(2)
    topics = [["cat", "cats", "dog", "pet"], ["bank", "banks", "loan", "money"], ["rain", "rainy", "snow", "cloud"]]
    rows = []
    for i in range(n):
        t = topics[i % 3]
        rows.append((i, [r.choice(t) if r.random() < 0.8 else r.choice(["some", "other", "word"]) for _ in range(r.randrange(2, 9))]))
    return rows


def dense(rows):
    counts = Counter()
    for _, toks in rows:
        for k, a in enumerate(toks):
            for b in toks[max(0, k - SW.WINDOW):k] + toks[k + 1:k + 1 + SW.WINDOW]:
                counts[a, b] += 1
    words = sorted({a for a, _ in counts})
    m = np.array([[counts[a, b] for b in words] for a in words], float)
    with np.errstate(divide="ignore"):
        p = np.maximum(np.log(m * m.sum() / (m.sum(1)[:, None] * m.sum(0)[None])), 0)
    return words, np.where(m > 0, p, 0)


def cosines(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return u @ u.T


def test_block_iteration_finds_the_leading_directions(spark):
    rows = corpus()
    tokens = spark.createDataFrame(rows, "id long, toks array<string>")
    words, p = dense(rows)
    info = {(r["a"], r["b"]): r["w"] for r in SW.information(SW.cooccurrences(tokens)).collect()}
    assert all(abs(info.get((a, b), 0.0) - p[i, j]) < 1e-9 for i, a in enumerate(words) for j, b in enumerate(words))
    values, directions = np.linalg.eigh(p)
    top = np.argsort(-np.abs(values))[:3]  # the others are close to each other
    want = cosines(p @ directions[:, top])
    got = {r["word"]: r["vec"] for r in SW.word_vectors(tokens.repartition(3), dim=3, rounds=8).collect()}
    assert sorted(got) == words and np.abs(cosines(np.array([got[w] for w in words])) - want).max() < 1e-4


def test_strings_and_terms(spark):
    tokens = spark.createDataFrame(corpus(), "id long, toks array<string>")
    vectors = SW.word_vectors(tokens, dim=4)
    table = SW.unit_vectors(vectors, 4)
    asked = spark.createDataFrame([("catz",), ("cat",), ("zzzz",), ("my loan",)], "phrase string")
    found = {r["phrase"]: r["v"] for r in SW.string_vectors(asked, table, 4).collect()}
    assert set(found) == {"catz", "cat", "my loan"}  # no n-gram of the other is known
    train = spark.createDataFrame([(i, " ".join(t), "a") for i, t in corpus()], "id long, text string, intent string")
    terms = {}
    for r in SW.fitted_terms(train, asked, topn=3, dim=4).collect():
        terms.setdefault(r["phrase"], []).append((r["rank"], r["term"]))
    assert {k: len(v) for k, v in terms.items()} == {"catz": 3, "cat": 3, "my loan": 3}
    assert "cat" not in [t for _, t in terms["cat"]] and {t for _, t in terms["catz"]} <= {"cat", "cats", "dog", "pet"}
    assert SW.word_vectors(tokens.filter("false")).count() == 0


def test_enhanced_keywords_filter_single_words(spark):
    train = spark.createDataFrame([(1, "lonely", "a"), (2, "red car and the car", "a")], "id long, text string, intent string")
    given = spark.createDataFrame([("lonely", "send"), ("red car", "wheel")], "phrase string, term string").selectExpr("phrase", "1 AS rank", "term")
    kw = TO.rake_keywords_enhanced(train, lambda phrases: given)
    # a single word that is in no longer phrase goes, similar terms come, stop words go
    assert sorted(r["phrase"] for r in kw.collect()) == ["car", "red car", "wheel"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    near = TO.similar_terms(TO.mean_of_words(spark.createDataFrame([("a",), ("a b",)], "phrase string"), vectors), vectors, 2)
    assert {(r["phrase"], r["term"]) for r in near.filter("rank <= 2").collect()} == {("a", "b"), ("a", "c"), ("a b", "a"), ("a b", "b")}


def test_phrase_vectors_are_evaluated_once(spark, monkeypatch):
    """The engine counts, scans and joins the phrases: it reads their vectors written."""
    from strayscope.operators import pairs as PR
    from strayscope.operators import text as TO
    df = spark.createDataFrame([("a b", [1.0, 0.1]), ("c", [0.2, 1.0])], "phrase string, v array<double>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.4]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    for limit in (0, 1 << 20):
        monkeypatch.setattr(PR, "DEFAULT_BROADCAST_BYTES", limit)
        evaluated = spark.sparkContext.accumulator(0)

        def counted(batches, evaluated=evaluated):
            for batch in batches:
                evaluated.add(batch.num_rows)
                yield batch
        found = TO.similar_terms(df.mapInArrow(counted, df.schema), words, 2)
        assert sorted((r["phrase"], r["rank"], r["term"]) for r in found.collect()) == [("a b", 1, "a"), ("a b", 2, "b"), ("c", 1, "b"), ("c", 2, "a")]
        assert evaluated.value == 2


def test_pairs_of_words_travel_as_runs(spark):
    """Each task adds up its pairs: an exchange gets a few runs of numbers, not a row for each pair."""
    tokens = spark.createDataFrame(corpus(), "id long, toks array<string>")
    words, seed = SW.numbered(SW.distinct_words(tokens))
    rows = SW.cooccurrence_rows(tokens, words, seed)
    assert "block" in rows._jdf.queryExecution().analyzed().toString() and "explode" not in rows._jdf.queryExecution().analyzed().toString()
    name = {r["idx"]: r["word"] for r in words.collect()}
    got = {(name[r["a"]], name[b]): n for r in rows.collect() for b, n in zip(r["bs"], r["ns"])}
    want = Counter()
    for _, toks in corpus():
        for k, a in enumerate(toks):
            for b in toks[max(0, k - SW.WINDOW):k] + toks[k + 1:k + 1 + SW.WINDOW]:
                want[a, b] += 1
    assert got == dict(want) and sorted(name) == list(range(len(name)))


def test_similar_terms_query_has_all_columns_and_phrases(spark, monkeypatch):
    """As many columns as the reference's vectors, for every phrase."""
    from strayscope.plans import catalog
    asked = {}

    def seen(train, phrases, topn=5, text_col="text", dim=SW.DIM):
        asked.update(dim=dim, topn=topn, phrases=sorted(r["phrase"] for r in phrases.collect()))
        return phrases
    monkeypatch.setattr(SW, "fitted_terms", seen)
    rows = [(1, "lonely", "a"), (2, "red car and the car", "a")]
    train = spark.createDataFrame(rows, "id long, text string, intent string")
    monkeypatch.setattr(catalog, "_utt", lambda spark, sf_dir: catalog.FX.Splits(train, train, train))
    catalog.QUERIES["similar_terms"](spark, "")
    assert asked == {"dim": 100, "topn": 5, "phrases": ["car", "lonely", "red car"]}
