"""Exact pair engine: broadcast and block (cogroup) paths agree with numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strayscope.operators.pairs import NearestOp, SoftmaxStatsOp, pair_scan


def _frames(spark, n=60, m=90, d=5, seed=0):
    rng = np.random.default_rng(seed)
    q, r = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    r[7] = q[3]  # exact duplicate -> distance 0
    labels = [f"c{i % 4}" for i in range(m)]
    labels[11] = "single"
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(n)], "id long, v array<double>")
    rdf = spark.createDataFrame([(1000 + j, r[j].tolist(), labels[j]) for j in range(m)],
                                "id long, v array<double>, intent string")
    return q, r, labels, qdf, rdf


@pytest.mark.parametrize("block", [False, True])
def test_min_l2_and_topk(spark, block):
    q, r, labels, qdf, rdf = _frames(spark)
    kw = dict(broadcast_bytes=0, block_bytes=512) if block else {}
    d = np.sqrt(((q[:, None, :] - r[None, :, :]) ** 2).sum(-1))
    got = {x["qid"]: x["value"] for x in pair_scan(qdf, rdf, NearestOp(1, "l2"), **kw).collect()}
    assert np.allclose([got[i] for i in range(len(q))], d.min(1), atol=1e-12)
    top = pair_scan(qdf, rdf, NearestOp(3, "l2"), **kw).collect()
    for row in top:
        order = np.lexsort((np.arange(len(r)), d[row["qid"]]))
        assert row["ref_id"] - 1000 == order[row["rank"] - 1]


@pytest.mark.parametrize("block", [False, True])
def test_per_class_second_neighbour(spark, block):
    q, r, labels, qdf, rdf = _frames(spark)
    kw = dict(broadcast_bytes=0, block_bytes=512) if block else {}
    nn = pair_scan(qdf, rdf, NearestOp(2, "l2", by_class=True), label_col="intent", **kw)
    got = {(x["qid"], x["cls"]): x["d"] for x in
           nn.groupBy("qid", "cls").agg(F.max_by("value", "rank").alias("d")).collect()}
    lab = np.array(labels)
    for i in range(len(q)):
        for c in set(labels):
            dist = np.sort(np.sqrt(((r[lab == c] - q[i]) ** 2).sum(-1)))
            want = dist[1] if len(dist) > 1 else dist[0]
            assert got[(i, c)] == pytest.approx(want, abs=1e-12)


def test_softmax_stats_block_equals_broadcast(spark):
    _, _, _, qdf, rdf = _frames(spark)
    a = sorted(tuple(x) for x in pair_scan(qdf, rdf, SoftmaxStatsOp()).collect())
    b = sorted(tuple(x) for x in pair_scan(qdf, rdf, SoftmaxStatsOp(), broadcast_bytes=0, block_bytes=512).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and x[2] == y[2] and x[4] == y[4]
        assert x[1] == pytest.approx(y[1], abs=1e-12) and x[3] == pytest.approx(y[3], rel=1e-12)


def test_exclude_self(spark):
    _, r, _, _, rdf = _frames(spark)
    nn = pair_scan(rdf, rdf, NearestOp(1, "l2", exclude_self=True)).collect()
    assert all(x["ref_id"] != x["qid"] for x in nn)


@pytest.mark.parametrize("name", ["knn", "cosine_nn", "cosine_entropy", "lof", "trust_score", "pca_euclidean"])
def test_detectors_block_path_equals_broadcast(spark, name, monkeypatch):
    """Splits of one table share lineage: the cogroup path must still see both sides."""
    from strayscope.operators import detectors as D
    from strayscope.operators import pairs as PR
    from strayscope.sources import fixtures as FX
    sp = FX.vector_splits(spark, "/root/testdata/sf0.001")
    want = {r["id"]: r["score"] for r in D.get_detector(name).fit(sp.train).score(sp.test).collect()}
    monkeypatch.setattr(PR, "DEFAULT_BROADCAST_BYTES", 0)
    monkeypatch.setattr(PR, "DEFAULT_BLOCK_BYTES", 32 << 10)
    got = {r["id"]: r["score"] for r in D.get_detector(name).fit(sp.train).score(sp.test).collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("kind", ["l2", "cosine_sim", "by_class", "same_label", "exclude_self"])
def test_bounds_of_earlier_chunks_lose_nothing(kind, monkeypatch):
    """References in many chunks: the k nearest are those of a full sort, and of the pairs
    only few are looked at beyond the product."""
    import pandas as pd

    from strayscope.operators import pairs as PR
    monkeypatch.setattr(PR, "REF_CHUNK", 50)
    monkeypatch.setattr(PR, "TIED_PAIRS", 300)
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(30, 6)), rng.normal(size=(3000, 6))
    r[100:140] = q[0]  # ties go to the smallest ids
    ids = rng.permutation(3000)
    labels = np.array([None if j % 7 == 0 and kind != "by_class" else f"c{j % 3}" for j in range(3000)], dtype=object)
    qlabel = np.array([labels[j] for j in range(30)], dtype=object)
    op = NearestOp(4, "cosine_sim" if kind == "cosine_sim" else "l2", **({kind: True} if kind in ("by_class", "same_label", "exclude_self") else {}))
    seen = []
    exact = op._exact
    op._exact = lambda a, b, qi, ri: seen.append(len(qi)) or exact(a, b, qi, ri)
    got = op.run(pd.DataFrame({"id": np.arange(30), "v": list(q), "qlabel": qlabel}), PR.RefBlock(ids, r, labels))
    value = np.sqrt(((q[:, None] - r[None]) ** 2).sum(-1))
    if kind == "cosine_sim":
        value = -(q @ r.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(r, axis=1)
    for i in range(30):
        for cls in (set(labels) if kind == "by_class" else [0]):
            mine = np.flatnonzero({"by_class": labels == cls, "same_label": labels == qlabel[i], "exclude_self": ids != i}.get(kind, labels == labels))
            want = mine[np.lexsort((ids[mine], np.round(value[i, mine], 12)))][:4]
            rows = got[got.qid == i]
            if kind == "by_class":
                rows = rows[rows.cls == cls]
            assert rows.ref_id.tolist() == ids[want].tolist() and rows["rank"].tolist() == [1, 2, 3, 4]
    assert sum(seen) < 30 * 3000 / 5


def test_small_blocks_are_dealt_into_few_bunches():
    """A row is sent once for each bunch of the other side, however small its blocks are."""
    from strayscope.operators.pairs import DEFAULT_BLOCK_BYTES, bunches
    assert bunches(200 << 20, 64 << 10, 8) == 8  # not 3,200
    assert bunches(5 * 512, 512, 8) == 5
    assert bunches(100 * DEFAULT_BLOCK_BYTES, 64 << 10, 8) == 100


def test_leaves_leave_no_neighbour_out(monkeypatch):
    """Near points in a few directions: the leaves skip most of them, and the nearest stay the same."""
    import pandas as pd
    from strayscope.operators import pairs as PR
    r = np.random.default_rng(4)
    refs, asked = (np.c_[r.normal(size=(n, 2)), 0.01 * r.normal(size=(n, 4))] for n in (6000, 1500))
    refs[:3], refs[3], refs[4:40] = 0.0, np.nan, refs[50]  # zero vectors, no number, many equal ones
    q = pd.DataFrame({"id": np.arange(len(asked)), "v": list(asked)})
    for metric in ("l2", "cosine_sim", "cosine_dist"):
        found = []
        for least in (1000, 1 << 40):
            monkeypatch.setattr(PR, "TREE_LEAST", least)
            block = PR.RefBlock(np.arange(len(refs))[::-1].copy(), refs, None)
            found.append(PR.NearestOp(3, metric, exclude_self=True).run(q, block).sort_values(["qid", "rank"]).to_numpy().tolist())
            if least == 1000:
                assert block.trees[None].pays() and block.trees[None].tried > PR.TREE_TRIED
        assert found[0] == found[1] and len(found[0]) == 3 * len(asked)


def test_nearest_among_many_moves_no_vectors(spark):
    """References over the broadcast limit are read from the shared folder: no exchange of either side."""
    from strayscope.operators.pairs import NearestOp, pair_scan
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = pair_scan(df.filter("id < 100"), df, NearestOp(2, "l2"), broadcast_bytes=0, block_bytes=2048)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan and "Repartition" not in plan.replace("RepartitionByExpression", "")
    assert {(x["qid"], x["ref_id"]) for x in found.filter("rank = 1").collect()} == {(i, i) for i in range(100)}
