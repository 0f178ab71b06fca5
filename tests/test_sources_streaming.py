"""Readers on small synthetic files, results ETL, streaming smoke, driver entry."""
import json
import os

import pytest
from pyspark.sql import functions as F

from strayscope.operators import detectors as D
from strayscope.sources import fixtures as FX
from strayscope.sources import readers as R
from strayscope.streaming.scoring import score_stream, vector_stream
from tests.conftest import SF001, SF01


def test_intent_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "data.json")
    with open(p, "w") as f:
        json.dump({"train": [["hi", "greet"], ["bye", "leave"]], "val": [["yo", "greet"]], "test": [["ciao", "leave"]],
                   "oos_train": [["weather?", "oos"]], "oos_val": [["x", "oos"]], "oos_test": [["y", "oos"]]}, f)
    df = R.read_intent_json(spark, p)
    assert df.filter("split = 'train'").count() == 2
    assert R.read_intent_json(spark, p, True).filter("split = 'train'").count() == 3
    assert df.filter("intent = 'oos'").count() == 2


def test_tsv_and_csv(spark, tmpdir_path):
    for name, rows in {"OODRemovedtrain.tsv": ["a/b\t-\thello there\tx"], "eval.tsv": ["outOfDomain\t-\twhat\tFILLER"],
                       "test.tsv": ["a/c\t-\tyo\tx"], "OODrelease.tsv": ["outOfDomain\t-\tzzz\tFILLER"]}.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("\n".join(rows) + "\n")
    df = R.read_intent_tsv(spark, tmpdir_path)
    assert {r["intent"] for r in df.collect()} == {"a/b", "oos", "a/c"}
    flagged = R.read_rostd_flagged(spark, os.path.join(tmpdir_path, "eval.tsv"), use_coarse_labels=True).first()
    assert flagged["ood"] == 1
    csvp = os.path.join(tmpdir_path, "s.csv")
    with open(csvp, "w") as f:
        f.write("text,labels,is_ood\nplay music,PlayMusic,0\nbook it,BookRestaurant,1\n")
    assert R.read_intent_csv(spark, csvp, "train").count() == 1
    assert R.read_intent_csv(spark, csvp, "test").filter("intent = 'oos'").count() == 1


def test_word_vectors(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "vec.txt")
    with open(p, "w") as f:
        f.write("the 0.1 0.2 0.3\ncat -1 0 2.5\n")
    rows = {r["word"]: r["vec"] for r in R.read_word_vectors(spark, p).collect()}
    assert rows["cat"] == [-1.0, 0.0, 2.5]


def test_results_etl(spark, tmpdir_path):
    files = {"clinc150_KNN_mpnet_False_False_oos.json": {"fpr_95": 0.1, "fpr_90": 0.05, "aupr": 0.9, "auroc": 0.95,
                                                          "f1": 0.7, "mcc": 0.6},
             "clinc150_ADB_mpnet-best-ckpt_True_False_oos_0.75_0.01.json": {"f1": 0.8, "mcc": 0.7},
             "rostd_LikelihoodRatio_None_False_False_oos.json": {"fpr90": 0.2, "fpr95": 0.3, "aupr": 0.5, "auroc": 0.6}}
    for n, c in files.items():
        with open(os.path.join(tmpdir_path, n), "w") as f:
            json.dump(c, f)
    rows = R.read_results(spark, tmpdir_path).collect()
    assert [r["detector"] for r in rows] == ["ADB", "KNN", "LikelihoodRatio"]
    assert rows[0]["feature_extractor"] == "mpnet" and rows[0]["adb_alpha"] == "0.75"
    assert rows[2]["fpr_95"] == 0.3
    out = os.path.join(tmpdir_path, "csv")
    R.write_results_csv(R.read_results(spark, tmpdir_path), out)
    assert spark.read.option("header", True).csv(out).count() == 3


def test_streaming_scoring_smoke(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    FX.read_table(spark, SF001, "embeddings").repartition(4).write.parquet(src)
    train = FX.vector_splits(spark, SF001).train
    det = D.KNN().fit(train)
    q = score_stream(vector_stream(spark, src), det, os.path.join(tmpdir_path, "out"),
                     os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmpdir_path, "out"))
    assert out.count() == 500
    assert out.filter(F.col("score").isNull()).count() == 0


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"fpr_95", "fpr_90", "aupr", "auroc", "f1", "mcc"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_streaming_rowwise_mahalanobis(spark, tmpdir_path):
    from strayscope.streaming.scoring import score_stream_rowwise
    src = os.path.join(tmpdir_path, "in")
    FX.read_table(spark, SF001, "embeddings").repartition(3).write.parquet(src)
    det = D.Mahalanobis().fit(FX.vector_splits(spark, SF001).train)
    q = score_stream_rowwise(vector_stream(spark, src), det, os.path.join(tmpdir_path, "out"),
                             os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmpdir_path, "out"))
    batch = {r["id"]: r["score"] for r in det.score(FX.vector_table(spark, SF001)).collect()}
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got.keys() == batch.keys()
    assert all(abs(got[k] - batch[k]) < 1e-9 for k in got)


def test_every_query_has_an_oracle_except_the_rows_only_set():
    from strayscope.plans import catalog
    # iterative fits and the sweep of them
    rows_only = {"bench_doc_trained", "bench_doc_trained_with_ood", "bench_ml_linear_svc_msp", "bench_ml_logreg_msp",
                 "bench_ml_random_forest_msp", "bench_msp_best_checkpoint", "bench_rake_enhanced", "bench_svc_rbf_msp",
                 "hpo_logreg_cv", "hpo_shared_scans", "similar_terms", "sweep_vector_grid"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == rows_only
