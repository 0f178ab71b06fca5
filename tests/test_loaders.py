"""Named datasets over small files: stable ids, OOD conventions, splits."""

import json
import os

import pytest

from strayscope.sources import loaders as L
from strayscope.sources import readers as R


def put(root, name, lines):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture()
def root(tmpdir_path):
    r = tmpdir_path
    put(r, "rostd/OODRemovedtrain.tsv", ["alarm/set\t-\tset it\tx"] * 3 + ["alarm/off\t-\tstop \"\"it\tx"])
    put(r, "rostd/OODrelease.tsv", ["outOfDomain\t-\twhat\tFILLER"])
    put(r, "rostd/eval.tsv", ["outOfDomain\t-\twhy\tFILLER", "alarm/set\t-\tset it\tx"])
    put(r, "rostd/test.tsv", ["weather/find\t-\train?\tFILLER", "outOfDomain\t-\teh\tx"])
    for s in L.SUBSETS:
        for k, v in ((75, 0), (25, 2)):
            put(r, f"snips/snips_{s}_{k}_{v}.csv", ["text,labels,is_ood", "play,Music,0", "\"a, b\",Book,1", "play,Music,0"])
        put(r, f"yellow/{s}.csv", ["text,intent", "hi,greet", "x,oos"])
        put(r, f"sst/{s}.tsv", ["fine film\t1", "bad film\t0"])
    for s, name in (("val", "dev"), ("test", "test")):
        put(r, f"sst/rte/{name}.tsv", ["index\tsentence1\tsentence2\tlabel", "0\tone\ttwo\tx"])
        put(r, f"sst/wmt16/{s}.en", ["a foreign, line", "a foreign, line"])
    parts = {"train": [["hi", "greet"], ["hi", "greet"]], "val": [["yo", "greet"]], "test": [["ciao", "leave"]],
             "oos_train": [["rain", "oos"]], "oos_val": [["x", "oos"]], "oos_test": [["y", "oos"], ["y", "oos"]]}
    put(r, "clinc150/data_full.json", [json.dumps(parts)])
    return r


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(L.DATASETS))
def test_datasets(spark, root, name):
    got = L.load(spark, name, root)
    assert got.columns == ["id", "text", "intent", "split"]
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and {r["split"] for r in got.collect()} == set(L.SUBSETS)
    assert got.filter("split = 'train' AND intent = 'oos'").count() == 0
    assert got.filter("split <> 'train' AND intent = 'oos'").count() > 0
    more = L.load(spark, name, root, include_ood_in_train=True)
    assert more.filter("split = 'train' AND intent = 'oos'").count() == 1
    assert set(ids) <= {r["id"] for r in more.collect()}  # asking for more rows renumbers none
    with pytest.raises(ValueError):
        L.load(spark, "nothing", root)


def test_subset_loaders(spark, root):
    fine, coarse = L.subset_loader(spark, "rostd", root), L.subset_loader(spark, "rostd_coarse", root)
    assert rows(fine("test"), "text", "intent", "ood") == [("eh", "oos", 0), ("rain?", "weather/find", 1)]
    assert rows(coarse("train"), "intent", "ood") == [("alarm", 0)] * 4 and rows(coarse("val"), "intent") == [("alarm",), ("oos",)]
    assert rows(L.subset_loader(spark, "snips_25", root, version=2)("train"), "text", "ood") == [("play", 0), ("play", 0)]
    assert rows(L.subset_loader(spark, "snips_75", root, version=0)("test"), "text", "intent", "ood") == [("a, b", "oos", 1), ("play", "Music", 0), ("play", "Music", 0)]
    clinc = L.subset_loader(spark, "clinc", root)
    assert rows(clinc("train"), "ood") == [(0,), (0,)] and rows(clinc("test"), "text", "ood") == [("ciao", 0), ("y", 1), ("y", 1)]
    sst = L.subset_loader(spark, "sst", root, ood_type="rte")
    assert rows(sst("val"), "text", "intent", "ood") == [("bad film", "negative", 0), ("fine film", "positive", 0), ("one two", "oos", 1)]
    lines = L.subset_loader(spark, "sst", root, ood_type="wmt16")("test")
    assert rows(lines.filter("ood = 1"), "text") == [("a foreign, line",)] * 2 and len(set(rows(lines, "id"))) == 4
    assert rows(sst("train"), "ood") == [(0,), (0,)]
    with pytest.raises(NotImplementedError):
        L.subset_loader(spark, "clinc_sup", root)("train")
    for name, settings in (("nothing", {}), ("snips_75", {}), ("rostd", {"version": 1}), ("sst", {"ood_type": "none"})):
        with pytest.raises(ValueError):
            L.subset_loader(spark, name, root, **settings)("val")


def test_vocabulary_of_the_wanted_subsets(spark, root):
    loader = L.subset_loader(spark, "sst", root, ood_type="wmt16")
    coded, vocab = L.encoded_splits(loader, max_tokens=2)
    assert rows(vocab, "word", "idx") == [("bad", 6), ("film", 5)]
    assert rows(coded["train"], "pos", "token_id") == [(0, 3), (0, 6), (1, 5), (1, 5)]
    _, wide = L.encoded_splits(loader, ("train", "val", "test"))
    assert {"foreign", "fine"} <= {w for w, in rows(wide, "word")}


def test_ids_are_places_in_the_file(spark, tmpdir_path):
    """The same for any cut of the files into tasks; repeated rows keep their own."""
    lines = [f"l{k % 3}\t-\ttext {k % 5} {'é' * (k % 7)}\tx" for k in range(5000)]
    folder = os.path.join(tmpdir_path, "many.tsv")
    put(folder, "part-00000.csv", lines[:2000])
    put(folder, "part-00001.csv", lines[2000:2001])
    put(folder, "part-00002.csv", lines[2001:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "7k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = R.read_rostd_flagged(spark, folder, split="val")
            assert sorted(r["id"] - (1 << 40) for r in got.collect()) == list(range(5000))
            texts = {r["id"] - (1 << 40): r["text"] for r in got.collect()}
            assert all(texts[k] == lines[k].split("\t")[2] for k in range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
