"""Fill-in-the-middle, filter audit and cross-polytope search against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strayscope.llm import fill_middle, filter_audit, polytope_search
from strayscope.llm.common import prepare

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
DOCS = "doc_id long, text string, lang string, n long, form string, mask string, part string, steps string"


def offsets(text):
    return [0] + list(itertools.accumulate(len(t) for t in TOKEN.findall(text)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abzAZ09 .\nßé漢😀", max_size=60))
def test_boundaries_are_the_token_ends(text):
    marks = fill_middle.boundaries(text)
    assert [marks.select(k) for k in range(len(marks))] == offsets(text)


def test_containers_over_many_chunks():
    r = random.Random(5)
    dense = "".join(r.choice(["a ", "bc", ". ", "é"]) for _ in range(70_000))
    text = "x" * 140_000 + dense + "漢" * 150_000 + "word " * 3
    marks, want = fill_middle.boundaries(text), offsets(text)
    assert len(marks) == len(want) and set(marks.kinds) == {"array", "bitmap", "run"}
    for k in [0, 1, 2, len(want) - 1, *(r.randrange(len(want)) for _ in range(500))]:
        assert marks.select(k) == want[k]
    with pytest.raises(IndexError):
        marks.select(len(want))


def middle_by_hand(doc_id, text):
    text = text or ""
    words = TOKEN.findall(text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(words)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    prepare(spark)
    r = random.Random(1)
    rows = [(i, "".join(r.choice(["ab", " ", "é", "<", "S", ">", "\n", "漢", "1"]) for _ in range(r.randrange(40)))) for i in range(300)]
    rows += [(1, rows[1][1]), (None, "no key here"), (None, None), (400, None), (401, ""), (402, "has <M> in it"), (403, "x" * 70_000 + " y" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", 1, "f", "m", "p", "s") for i, t in rows], DOCS)
    made = fill_middle.fill_in_middle(docs)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [(i, *middle_by_hand(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.filter("false")).count() == 0


def audit_by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])) if bad}
        rows.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = set()
    for part in {p for p, *_ in rows}:
        mine, removed_by = [x[1:] for x in rows if x[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [x for x in mine if f in x[0] and not x[0] & set(order[:k])]
                steps.append((part, "".join(order), k + 1, sum(not x[0] & set(order[:k + 1]) for x in mine), len(here),
                              sum(f in x[0] for x in mine) - len(here), sum(x[0] == {f} for x in mine), sum(x[1] for x in here), sum(x[2] for x in here)))
                removed_by[f] += len(here)
        out |= {(*s, removed_by[s[1][s[2] - 1]]) for s in steps}
    return out


def test_filter_audit(spark):
    prepare(spark)
    r = random.Random(2)
    texts = [" ".join(r.choice(["Alpha", "beta", "gamma#", f"w{k}", f"v{j}"]) for j in range(r.choice([3, 150, 260]))) for k in range(12)]
    texts += [" ".join(f"w{j}" for j in range(200)), " ".join(f"w{j % 99}" for j in range(200)), " ".join(f"w{j % 100}" for j in range(200)),
              "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "", None, "z " * 30_000]
    docs = [(r.randrange(40), r.choice(texts), r.choice(["en", "fr", None, ""])) for _ in range(150)] + [(None, texts[0], "en"), (None, texts[0], "de")]
    docs += docs[:5]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (900, 1, 1)]
    table = spark.createDataFrame([(i, t, x, 1, "f", "m", "p", "s") for i, t, x in docs], DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(table, known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == 600 * 4 and set(rows) == audit_by_hand(docs, labels)
    assert filter_audit.audit(table.filter("false"), known).count() == 0
    assert filter_audit.audit(table, known.filter("false")).agg(F.sum("good_lost")).first()[0] == 0


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, tab string")


def nearest_by_hand(rows, k, every):
    """query -> its whole ranking (score, id); repeated rows count once."""
    own = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = {}
    for q, v in own:
        if q % every == 0:
            x = np.array(v)
            sims = [(-float(np.dot(x, np.array(w)) / np.linalg.norm(x) / np.linalg.norm(w)), i) for i, w in own if i != q and len(w) == len(v)]
            out.setdefault(q, []).append(sorted((round(s, 12), i) for s, i in sims)[:k])
    return out


def test_polytope_search_on_hard_rows(spark):
    prepare(spark)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(1, 60)]
    rows += [(100 + i, rows[3][1]) for i in range(60)] + [(100 + i, rows[3][1]) for i in range(20)]  # copies, repeated rows
    rows += [(100, rows[5][1]), (200, [2 * x for x in rows[3][1]]), (300, None), (350, []), (400, [0.0] * 6), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (500, [float("nan")] * 6), (550, [float("inf")] + [1.0] * 5), (None, rows[3][1]), (600, [1.0, 0.0, 0.5]), (601, [1.0, 0.1, 0.5]), (650, [3.0])]
    got = {}
    for x in polytope_search.nearest(vectors_table(spark, rows), least_slice=4, block=2).collect():  # 12 signed axes: all are probed
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = nearest_by_hand(rows, 5, 50)
    assert set(got) == {q for q, lists in want.items() if any(lists)}
    for q, lists in want.items():
        found = sorted((round(-s, 12), i) for _, i, s in got.get(q, []))
        assert found == sorted(x for one in lists for x in one), q
        assert sorted(x[0] for x in got.get(q, [])) == sorted(k + 1 for one in lists for k in range(len(one)))
    assert got[600] == [(1, 601, got[600][0][2])] and 650 not in got
    assert polytope_search.nearest(vectors_table(spark, rows).filter("false")).count() == 0


@pytest.mark.parametrize("target", [polytope_search.TARGET, 8])
def test_polytope_search_recall(spark, target):
    """Against brute force, with one rotation and with a second one that splits the buckets."""
    prepare(spark)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 40)).astype(np.float32)
    v[:1300] = v[0] + 0.05 * rng.normal(size=(1300, 40))  # a third of all rows lies close together
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    df = vectors_table(spark, rows)
    got = {}
    for x in polytope_search.nearest(df, every=20, target=target, least_slice=64, block=16).collect():
        got.setdefault(x["query_id"], {})[x["vec_id"]] = x["score"]
    unit = v.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 4000, 20):
        sims = unit @ unit[q]
        assert len(got[q]) == 5 and all(abs(sims[i] - s) < 1e-12 for i, s in got[q].items())
        sims[q] = -2
        hit += len(set(np.argsort(-sims)[:5].tolist()) & set(got[q]))
    assert hit / 1000 >= 0.9
