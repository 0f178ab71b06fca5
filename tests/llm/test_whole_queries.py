"""Whole queries and the pipeline against plain versions, on the smallest given tables."""

import hashlib
import itertools
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from strayscope.llm import fuzzy_lines, mph_tokens
from strayscope.llm.common import prepare
from strayscope.llm.queries import END_ID, QUERIES, WORD_BPE

SF = "/root/testdata/sf0.001"


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_fuzzy_lines_by_all_pairs(spark):
    prepare(spark)
    lines, where = {}, {}  # lower-cased line -> first place
    for x in sorted(documents(), key=lambda x: x["doc_id"]):
        for k, line in enumerate((x["text"] or "").split("\n")):
            key = re.sub(rb"[A-Z]", lambda m: m[0].lower(), line.encode().strip(b" \t\x0b\x0c\r"))
            if key:
                lines.setdefault(key, (x["doc_id"], k))
                where[x["doc_id"], k] = key
    names = list(lines)
    sets = [fuzzy_lines.shingle_set(n) for n in names]
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(names)), key=lambda i: len(sets[i]))
    for a, i in enumerate(order):
        for j in order[a + 1:]:
            if 80 * len(sets[j]) > 100 * len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    number = {n: i for i, n in enumerate(names)}
    first = {}
    for i, n in enumerate(names):
        first[root(i)] = min(first.get(root(i), lines[n]), lines[n])
    want = {}
    for place, n in where.items():
        if place != first[root(number[n])]:
            want[place[0]] = want.get(place[0], 0) + 1
    got = {r["doc_id"]: r["lines_removed"] for r in QUERIES["op5_fuzzy_lines"](spark, SF).collect()}
    assert len(got) == len(documents()) and {d: n for d, n in got.items() if n} == want and sum(want.values()) > 100


def test_token_files_equal_the_library(spark):
    prepare(spark)
    path = public_tokenizers.path(WORD_BPE)
    lib = Tokenizer.from_file(path)

    def crc(text):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    start, want = 0, set()
    for x in sorted(documents(), key=lambda x: x["doc_id"]):
        n, c = crc(x["text"])
        want.add((x["doc_id"], start, n, c))
        start += n
    assert {tuple(r) for r in QUERIES["op8_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want
    rows = [(5, "five of them"), (5, "again five"), (None, "no key"), (None, None), (-3, "Less, than. zero!"), (7, ""), (7, "x" * 30_000 + " end.")]
    got = mph_tokens.token_file_round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, END_ID, shards=2).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), *crc(t)) for i, t in rows)
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))


KINDS = (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
         ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))


def test_base_secrets_equal_python(spark):
    prepare(spark)
    more = SF.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in QUERIES["op6_secret_scan"](spark, more).collect()}
    some = 0
    for x in pq.read_table(f"{more}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        spans = []
        for order, (kind, pattern, ok) in enumerate(KINDS):
            spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, x["text"] or "", re.A) if ok(m)]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        r = got[x["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[2] == k for s in spans) for k, _, _ in KINDS]
        some += bool(spans)
    assert some > 3


HARD = "doc_id long, text string, lang string, source string, n_chars long, _key string, lang_pred string, lines_removed int"


@pytest.fixture()
def hard(spark):
    prepare(spark)
    prose = ["the " + " and they ".join(f"word{k}x{j} was here" for j in range(40)) for k in range(30)]
    rows = [(k, t, "en") for k, t in enumerate(prose)]
    rows += [(100, prose[0], "en"), (101, prose[1].replace("x39", "y39"), "en"), (102, None, "en"), (103, "", None), (104, "12 34 !!", "en"),
             (None, prose[2] + " own end", "en"), (5, prose[5], "en"), (106, prose[6] + "\n\n" + prose[7], "en"), (107, "the long and " * 30_000, "en")]
    return spark.createDataFrame([(i, t, y, "s", len(t or ""), "k", "p", 0) for i, t, y in rows], HARD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_hard_rows(spark, hard, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (hard, hard.filter("false")):
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "bpe_encoding":
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert len(rows) == docs.count() and all(r["n_tokens"] == len(r["ids"]) and lib.decode(r["ids"], skip_special_tokens=False) == r["text"] for r in rows)
            continue
        assert out.columns == docs.columns and len(rows) <= docs.count()
    rows = stage(spark, hard, SF).collect()
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    if name == "language_id":
        assert not {102, 103, 104} & set(ids) and set(range(30)) <= set(ids)
    elif name == "line_dedup":
        assert set(range(30)) <= set(ids) and 100 not in ids and 106 not in ids and all(r["n_chars"] == len(r["text"] or "") for r in rows)
    elif name == "ngram_jaccard":
        assert not {100, 101} & set(ids) and set(range(30)) <= set(ids) and 107 in ids
    elif name == "decontamination":
        assert len(rows) == hard.count()  # none holds a benchmark item


def test_run_is_the_chain_of_its_stages(spark):
    prepare(spark)
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {(r["doc_id"], r["n_tokens"], r["text"]) for r in docs.collect()} == {(r["doc_id"], r["n_tokens"], r["text"]) for r in out}
    assert 0 < len(out) <= len(documents())
