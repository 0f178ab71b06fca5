"""Sentence spans: removed text against a plain version, recall on 51-word windows."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from strayscope.llm import sentence_spans as S
from strayscope.llm.common import prepare

SF = "/root/testdata/{}/documents.parquet"


def cleaned_by_hand(docs):
    """{place of the row: (text, removed sentences, sources)}; docs are (doc_id, text) with different keys."""
    units, first_seen = {}, {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        raw = (text or "").encode()
        starts, heads, opens, _, codes = S.pieces(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = raw.split()
        assert len(words) == len(codes)
        edges = [*heads.tolist(), len(words)]
        units[doc_id] = raw, starts.tolist(), edges, opens.tolist(), words
    covered, sources = {d: set() for d in units}, {d: set() for d in units}
    for doc_id, (_, _, edges, _, words) in units.items():
        for a in range(len(edges) - 1):
            b = a + S.UNITS
            while b < len(edges) and edges[b] - edges[a] < S.WORDS:
                b += 1
            if b >= len(edges):
                continue
            span = tuple(words[edges[a]:edges[b]])
            if span in first_seen:
                covered[doc_id] |= set(range(a, b))
                sources[doc_id].add(first_seen[span])
            else:
                first_seen[span] = doc_id
    out = {}
    for doc_id, (raw, starts, edges, opens, words) in units.items():
        sentence = (np.cumsum(opens) - 1).tolist()
        gone = set()
        for s in set(sentence):
            own = [u for u, x in enumerate(sentence) if x == s]
            size = edges[own[-1] + 1] - edges[own[0]]
            hit = [u for u in own if u in covered[doc_id]]
            if size > S.LONG or len(hit) == len(own):
                gone |= set(hit)
        if gone:
            cuts = [*starts, len(raw)]
            text = (raw[:cuts[0]] + b"".join(raw[a:b] for u, (a, b) in enumerate(zip(cuts, cuts[1:])) if u not in gone)).decode().rstrip()
        else:
            text = raw.decode()
        out[doc_id] = text, len({sentence[u] for u in gone}), bool(sources[doc_id])
    return out


def prose(r, n):
    return " ".join(f"w{r.randrange(10**6)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


def check(spark, docs, parts):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = {x["doc_id"]: (x["text"] or "", x["n_removed"], bool(x["source_ids"])) for x in S.dedup_spans(frame).collect()}
    want = cleaned_by_hand(docs)
    assert got.keys() == want.keys() and [d for d in want if got[d] != want[d]] == []


@pytest.mark.parametrize("together", [S.TOGETHER, 50])
def test_equal_to_a_plain_version(spark, monkeypatch, together):
    prepare(spark)
    monkeypatch.setattr(S, "TOGETHER", together)
    r = random.Random(6)
    passages = [prose(r, n) for n in (8, 20, 60, 200)]
    docs = [(k, " ".join(r.choice([prose(r, r.randrange(1, 40)), r.choice(passages)]) for _ in range(r.randrange(5)))) for k in range(150)]
    docs += [(200 + k, docs[k][1]) for k in range(10)] + [(300, passages[2] + "\n" + passages[2]), (301, "one. " * 3000), (302, "one. " * 3000), (303, "")]
    check(spark, docs, 5)


def test_given_documents(spark):
    prepare(spark)
    rows = pq.read_table(SF.format("sf0.001"), columns=["doc_id", "text"]).to_pylist()
    check(spark, [(x["doc_id"], x["text"]) for x in rows], 3)


def test_recall_on_windows_of_51_words(spark):
    prepare(spark)
    rows = pq.read_table(SF.format("sf0.01"), columns=["doc_id", "text"]).to_pylist()
    clean = {x["doc_id"]: " ".join(x["text"].split()) for x in S.dedup_spans(spark.createDataFrame([(x["doc_id"], x["text"]) for x in rows], "doc_id long, text string")).collect()}
    seen, passages, untouched = set(), 0, 0
    for x in sorted(rows, key=lambda x: x["doc_id"]):
        words = (x["text"] or "").split()
        windows = [hash(tuple(words[k:k + 51])) for k in range(len(words) - 50)]
        hits = [k for k, h in enumerate(windows) if h in seen]
        for j, k in enumerate(hits):
            if j == 0 or hits[j - 1] != k - 1:
                end = k
                while end + 1 < len(windows) and windows[end + 1] in seen:
                    end += 1
                passages += 1
                untouched += " ".join(words[k:end + 51]) in clean[x["doc_id"]]
        seen.update(windows)
    assert passages > 100 and untouched <= 0.1 * passages
    print(f"{passages} repeated passages, {untouched} untouched")


def test_no_sentence_that_never_was(spark):
    """Sentences of up to LONG words go as a whole or stay as they are."""
    prepare(spark)
    shared = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    docs = [(1, f"One two three {shared} Next comes this here. And that is it."), (2, f"Three four five six {shared} Something else is here. No more.")]
    got = {x["doc_id"]: x["text"] for x in S.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs)


def test_long_texts_nulls_and_clashing_columns(spark):
    prepare(spark)
    r = random.Random(9)
    long = prose(r, 60_000)
    rows = [(1, long), (2, long), (None, long), (3, None), (2, long)]
    docs = spark.createDataFrame([(i, t, "x", 0, "h") for i, t in rows], "doc_id long, text string, _key string, first int, source_ids string")
    got = S.dedup_spans(docs).collect()
    assert sorted((str(x["doc_id"]), len(x["text"] or "") > 1000) for x in got) == [("1", True), ("2", False), ("2", False), ("3", False), ("None", True)]
    assert all(x["source_ids"] == [1] for x in got if x["doc_id"] == 2)
