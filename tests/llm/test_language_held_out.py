"""Held-out accuracy of the language field, and long texts."""

import pyarrow.parquet as pq

from strayscope.llm import crf_language
from strayscope.llm.common import prepare
from strayscope.llm.queries import QUERIES


def test_held_out_documents(spark):
    prepare(spark)
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = [r for r in QUERIES["op9_language_id"](spark, sf).collect() if r["held_out"] and lang[r["doc_id"]] is not None]
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows)
    print(f"{right} of {len(rows)} held-out documents")
    assert len(rows) > 200 and right >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_a_very_long_text_is_one_language(spark):
    prepare(spark)
    labelled = [(k, ("der und die nicht " if k % 2 else "the and they with ") * 30, "de" if k % 2 else "en") for k in range(40)]
    docs = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = crf_language.train_on(docs)
    long = spark.createDataFrame([(1, "und die der nicht " * 50_000), (2, "with the and they " * 50_000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in crf_language.with_language(long, model).collect()}
    assert got == {1: "de", 2: "en", 3: "und"}
