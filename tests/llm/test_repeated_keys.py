"""Operator 1 on rows that repeat a doc_id with another text: one node of the graph."""

from strayscope.llm import ngram_join
from strayscope.llm.common import prepare


def test_a_document_has_one_component(spark):
    prepare(spark)
    texts = {c: " ".join(f"{c}{k}" for k in range(30)) for c in "abcd"}
    rows = [(1, texts["a"]), (7, texts["a"]), (5, texts["b"]), (7, texts["b"]), (9, texts["c"]), (9, ""), (12, texts["d"]), (12, texts["c"]), (20, texts["d"]), (30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in ngram_join.jaccard_components(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == {1: {1}, 7: {1}, 5: {1}, 9: {9}, 12: {9}, 20: {9}, 30: {30}}
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one_per_component(docs).collect())
    assert kept == [1, 9, 9, 30]
