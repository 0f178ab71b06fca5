"""The llm operators on small tables: nulls, empty and repeated rows, empty tables,
clashing column names, and brute-force versions."""

import itertools
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strayscope.llm import crf_language, fuzzy_lines, kd_search, linking, markov_secrets, mph_tokens, ngram_join, phrase_index, sentence_spans, warc_zstd
from strayscope.llm import bpe_prefix
from strayscope.llm.common import prepare
from strayscope.llm.queries import BYTE_BPE, ORACLES, QUERIES, WORD_BPE
import public_tokenizers

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, bucket int"
LONG = " ".join(f"word{i} is here" for i in range(40))


@pytest.fixture()
def docs(spark):
    prepare(spark)
    near = LONG.replace("word39 is", "word39 was")
    rows = [(1, LONG), (2, LONG), (3, near), (4, None), (5, ""), (6, "two words"), (7, "Two  WORDS"), (None, LONG), (8, "a b c d e f g h i j k l m"),
            (8, "a b c d e f g h i j k l m"), (9, "12 !! --"), (10, "x" * 50_000)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 0) for i, t in rows], DOCS)


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe_encoding"]


def test_components_of_chains_and_stars(spark):
    prepare(spark)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (200, 3)]
    got = {r["id"]: r["component"] for r in linking.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(5, 40)) and got[200] == got[3] == 3
    assert linking.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_components(spark, docs):
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()]
    want = [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 6), (None, None), (8, 8), (8, 8), (9, 9), (10, 10)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 8, 8, 9, 10]
    assert ngram_join.jaccard_components(docs.filter("false")).count() == 0


def test_groups_near_the_threshold(spark):
    prepare(spark)
    r = random.Random(3)
    base, rows = [[f"w{g}x{i}" for i in range(90)] for g in range(3)], []
    for i in range(120):
        words = list(base[i % 3])
        for _ in range(r.randrange(7)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(86)} for i, t in rows}
    root = list(range(120))
    for _ in range(120):
        for a, b in itertools.combinations(range(120), 2):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == dict(enumerate(root)) and 3 < len(set(root)) < 120


def test_lines(spark, docs):
    rows = [(1, "same line of text here\nonly one"), (2, "Same line of text here \n\nanother"), (3, None), (None, "same line of text here")]
    small = spark.createDataFrame([(i, t, "_") for i, t in rows], "doc_id long, text string, _lines string")
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in fuzzy_lines.dedup_lines(small).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nanother", 1), 3: (None, 0), None: (rows[3][1], 0)}
    assert fuzzy_lines.line_report(docs.filter("false")).count() == 0


def test_spans(spark, docs):
    passage = "First sentence of it goes here. Second one follows now. A third ends the passage."
    rows = [(1, "Start. " + passage + " End of one."), (2, "Other start. " + passage + " Other end."), (3, None), (4, ""), (None, passage)]
    small = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, _spans int")
    got = {r["doc_id"]: r for r in sentence_spans.dedup_spans(small).collect()}
    assert got[2]["text"] == "Other start. Other end." and got[2]["n_removed"] == 3 and got[2]["source_ids"] == [1]
    assert got[1]["text"] == rows[0][1] and got[3]["text"] is None and got[4]["text"] == "" and got[None]["text"] == passage
    assert sentence_spans.dedup_spans(docs.filter("false")).count() == 0


def test_spans_of_long_and_merged_sentences(spark):
    prepare(spark)
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows, passages = [], []
    for k in range(30):  # 51 words and more without a whole sentence, or with one or two
        passages.append(". ".join(text(n) for n in ([51], [25, 26], [4, 43, 5], [20, 9, 9, 20])[k % 4]))
        rows += [(2 * k, f"{text(7)} {passages[k]} {text(9)}. {text(12)}."), (2 * k + 1, f"{text(5)}. {text(30)} {passages[k]} {text(4)}.")]
    short = "Only two sentences are in here. That is all of it."
    rows += [(100, short), (101, short), (102, text(60)), (103, rows[-1][1].upper())]
    got = {x["doc_id"]: x for x in sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for k, passage in enumerate(passages):
        a, b = got[2 * k], got[2 * k + 1]
        assert a["text"] == texts[2 * k] and b["source_ids"] == [2 * k] and b["n_removed"] > 0
        left = set(b["text"].replace(".", "").split())
        assert len(left & set(passage.replace(".", "").split())) <= 30
        assert set(texts[2 * k + 1].replace(passage, "").replace(".", "").split()) <= left
    assert got[100]["text"] == short and (got[101]["text"], got[101]["n_removed"]) == ("", 2)
    assert all(got[i]["text"] == texts[i] for i in (102, 103))


def test_bpe(docs):
    path = public_tokenizers.path(BYTE_BPE)
    rows = bpe_prefix.encode_documents(docs, path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert bpe_prefix.encoding_digests(docs, path).count() == 12 and bpe_prefix.encoding_digests(docs.filter("false"), path).count() == 0


def test_token_files(docs):
    path = public_tokenizers.path(WORD_BPE)
    rows = sorted(mph_tokens.token_file_round_trip(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False)) and rows[4]["n_tokens"] == 1
    assert mph_tokens.token_file_round_trip(docs.filter("false"), path).count() == 0


def test_archives(spark):
    prepare(spark)
    big = "y" * 150
    rows = [(3, "u", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", ""), (1, "u", big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted([(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_zstd.archive_round_trip(pages).collect()], key=str)
    assert got == sorted([(3, 150, "revisit", 1), (1, 150, "response", None), (1, 150, "response", None), (2, 5, "response", None), (4, 5, "response", None),
                          (5, 0, "response", None), (6, 0, "response", None), (None, 150, "response", None)], key=str)
    assert warc_zstd.archive_round_trip(pages.filter("false")).count() == 0


def test_top_k(spark):
    prepare(spark)
    rows = [(50, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]),
            (None, [1.0, 1.0]), (100, [2.0])]
    got = kd_search.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(50, 1, 2, 65536), (50, 2, 3, 65536), (100, 1, 7, 131072)]
    assert kd_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_secrets(spark):
    prepare(spark)
    key = "q9X7zK2mP4vT8wL1bN6c"
    texts = [f"é Password = \"{key}\" x", "AKIA" + "Z9" * 9 + " token:abc secret=token:abcdefg " + "0f" * 15, None, "", f"some_ordinary_identifier_name and {key[::-1]}Qz7"] * 2
    train = [(100 + i, f"token={hash_} ordinary_identifier_name another_name_of_things value_of_the_setting") for i, hash_ in enumerate(
        [r[0] for r in spark.range(1000).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))).collect()])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in list(enumerate(texts)) + train], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in markov_secrets.secret_report(docs).collect()}
    assert got[0]["spans"] == "assign:2:34" and (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"]) == (0, 1, 1)
    assert got[2]["spans"] == got[3]["spans"] == "" and got[4]["spans"].startswith("markov:34:") and "," not in got[4]["spans"]
    assert markov_secrets.secret_report(docs.filter("false")).count() == 0


def test_language(spark, docs):
    en = ["the cat sat on the mat and the dog ran", "this is what they have with that other thing", "where is the house of the man"]
    fr = ["le chat est sur la table avec les autres", "nous avons une maison dans cette ville", "où est la maison de cet homme"]
    rows = [(i, (en if i % 2 else fr)[i // 2 % 3], "en" if i % 2 else "fr") for i in range(60)] + [(90, None, "en"), (91, "12 !!", None), (92, "—…", "en"), (None, "the dog", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in crf_language.language_report(table).collect()}
    assert all(got[i]["lang_pred"] == y for i, _, y in rows[:60]) and {got[i]["lang_pred"] for i in (90, 91, 92)} == {"und"} and got[None]["lang_pred"] == "en"
    model = crf_language.train_on(table)
    tags = [lang for _, lang, _ in crf_language.tag_words(model, "the cat sat on the mat nous avons une maison")]
    assert tags[:5] == ["en"] * 5 and tags[-3:] == ["fr"] * 3
    assert sorted(r["doc_id"] for r in crf_language.keep_identified(table, model).filter("doc_id >= 90").collect()) == []
    assert crf_language.with_language(docs.filter("false"), None).count() == 0
    assert {r["lang_pred"] for r in crf_language.with_language(docs, None).collect()} == {"und"}


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "c d e f g h i j k l extra words"), (2, "TWO words"), (3, None), (4, ""), (None, "a b"), (1, "not there at all")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in phrase_index.contamination(docs, items).collect()}
    assert (8, 13, 10, 1, True) in got and (6, 2, 2, 1, True) in got and (7, 2, 2, 1, True) in got and (4, 0, 0, 0, False) in got
    clean = phrase_index.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == 8
    assert not any(r["contaminated"] for r in phrase_index.contamination(docs, items.filter("false")).collect())
    assert phrase_index.contamination(docs.filter("false"), items).count() == 0


def test_decontamination_decides_per_row(spark):
    prepare(spark)
    leak, clean = "so two words is it", "nothing of the kind here"
    rows = [(None, leak), (None, clean), (7, leak), (7, clean), (8, clean), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
    items = spark.createDataFrame([(1, "two WORDS")], "item_id long, text string")
    left = phrase_index.drop_contaminated(docs, items)
    assert left.columns == docs.columns and {r["_row"] for r in left.collect()} == {1, 3, 4, 5, 6} and left.count() == 5
    assert phrase_index.drop_contaminated(docs, items.filter("false")).count() == 7


def test_rows_that_share_a_key_but_not_the_text(spark):
    prepare(spark)
    rows = [(1, "a line that comes twice\nsomething"), (7, "x of its own\na line that comes twice"), (7, "y of its own\na unique line of text"),
            (7, "y of its own\na unique line of text"), (9, "a unique line of text")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _body int").repartition(3)
    got = {r["_body"]: r["text"] for r in fuzzy_lines.dedup_lines(docs).collect()}
    assert got[0] == rows[0][1] and got[1] == "x of its own" and got[2] == got[3] == rows[2][1] and got[4] == ""
    passage = "Here is a first sentence with words. And then a second one follows it."
    rows = [(1, passage), (7, "Some start. " + passage), (7, "Other start. These sentences are unique in all. No row but this has them.")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _body int").repartition(3)
    got = {r["_body"]: r["text"] for r in sentence_spans.dedup_spans(docs).collect()}
    assert got == {0: passage, 1: "Some start.", 2: rows[2][1]}


def test_text_in_many_languages_is_kept(spark):
    prepare(spark)
    r = random.Random(2)
    langs = {k: [c + v + c for c in cs for v in "aeiou"] for k, cs in {"p": "bdg", "q": "klm", "r": "npr", "s": "stv"}.items()}
    words = lambda k, n: " ".join("".join(r.choices(langs[k], k=2)) for _ in range(n))
    model = crf_language.fit([(words(k, 60), k) for k in langs for _ in range(40)])
    mixed = " ".join(words(k, 50) for k in langs)
    docs = spark.createDataFrame([(1, mixed), (2, words("p", 50)), (3, "12 !!")], "doc_id long, text string")
    assert {x["doc_id"]: x["score"] < 0.35 for x in crf_language.with_language(docs, model).collect()} == {1: True, 2: False, 3: True}
    assert {x["doc_id"] for x in crf_language.keep_identified(docs, model).collect()} == {1, 2}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(crf_language, "MAX_LABELS", 2)
    docs = spark.createDataFrame([(k, "some words here", f"l{k}") for k in range(3)], "doc_id long, text string, lang string")
    assert len(crf_language.training_sample(docs.filter("doc_id < 2"), "doc_id", "text", "lang")) == 2
    with pytest.raises(ValueError, match="more than 2 languages"):
        crf_language.training_sample(docs, "doc_id", "text", "lang")


def test_link_meets_neighbours_in_size_by_pivots(spark, monkeypatch):
    """A group whose sizes lie on both sides of a cut is joined by pivots, not by all pairs across the cut."""
    sizes = [264] * 150 + [265] * 40  # 1.25 ** 25 is 264.7
    buckets = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "bucket long, id long, size int")
    details = spark.createDataFrame([(k, n, [0]) for k, n in enumerate(sizes)], "id long, size int, sketch array<long>")
    tried, write = [], linking.written

    def counted(df, kind="table"):
        out = write(df, kind)
        if kind == "pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(linking, "written", counted)
    found = linking.link(buckets, 80, lambda ids: (details, lambda pairs: pairs.select("a", "b")), linking.near(80, 1))
    assert sorted((r["id"], r["component"]) for r in found.collect()) == [(k, 0) for k in range(len(sizes))]
    assert sum(tried) <= 3 * len(sizes)
