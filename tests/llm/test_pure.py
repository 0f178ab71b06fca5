"""Parts of the llm operators that need no Spark: against the library, brute force
and round trips."""

import io
import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strayscope.llm import crf_language, fuzzy_lines, kd_search, mph_tokens, ngram_join, phrase_index, sentence_spans, warc_zstd
from strayscope.llm.common import lean
from strayscope.llm.bpe_prefix import PrefixBPE
from strayscope.llm.common import bit_sketches, texts

ODD = ["", "   ", "a  b\n\n c", "it's we'll  <|endoftext|> x<|endoftext|>", "aaaaaaaaaaaaaaa bbbbbbb", "日本語テスト 🙂🙂", "x" * 5000,
       "  a b \x1c c\x85 d", "'S 'll ''re 12345 !!!\t\t x", "the\r\n the", "İstanbul ΣΑΣ ſo. ﬁ a.́ b x). ª º ŉ, é. don't"]


def noise(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeinrst  \n'ézñ12.,") for _ in range(r.randrange(200))) for _ in range(n)]


def test_prefix_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, lib = PrefixBPE(path), Tokenizer.from_file(path)
    for text in ODD + noise(500):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_word_cache_equals_the_library():
    words = mph_tokens.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    marked = ["a., b.!", "3.14, 2.", "don't! he's,", "“quoted.” end.", "x_. y", "w.).", "wait................ no", "é.è, ÜNÏ.", "ΟΔΟΣ. ΣΑΣ", "<|ENDOFTEXT|> <|endoftext|>.",
              "a\x1cb", "a\u00a0b.", "\u3000x", "İ. ŉ. ǅ.", "Ⅷ. ²,"]
    rows = ODD + noise(300, 2) + marked
    for size in (1, 200, 1 << 20):
        got = [ids for _, _, raw, offs in texts(pa.array(rows), size) for ids in words.encode(raw, offs)]
        for text, ids in zip(rows, got, strict=True):
            assert np.frombuffer(ids, words.dtype).tolist() == words.lib.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(3).integers(-1 << 62, 1 << 62, 5000)
    raw = mph_tokens.IndexFile.pack(keys, np.zeros(5000), np.arange(5000), np.ones(5000))
    index = mph_tokens.IndexFile(raw)
    ok, slots = index.find(keys)
    assert ok.all() and slots["at"].tolist() == list(range(5000)) and len(index.slots) == 5000
    assert index.find(keys + 1)[0].sum() == 0
    assert not mph_tokens.IndexFile(mph_tokens.IndexFile.pack(*[np.zeros(0, np.int64)] * 4)).find(keys[:3])[0].any()


def test_warc_round_trip_and_validation():
    pages = [(1, "http://a\r\nx", b"<p>" + b"x" * 300), (None, None, b""), (3, "u", "é\r\n\r\n".encode() * 9)]
    records = [warc_zstd.record_bytes(i, u, b, __import__("hashlib").sha256(b).hexdigest(), None) for i, u, b in pages]
    out = io.BytesIO()
    assert warc_zstd.write_archive(out, iter(records)) == 3
    got = list(warc_zstd.read_archive(io.BytesIO(out.getvalue()), block=7))
    assert [(g["page_id"], g["payload"]) for g in got] == [(i, b) for i, _, b in pages]
    with pytest.raises(warc_zstd.ArchiveError):
        list(warc_zstd.read_archive(io.BytesIO(out.getvalue()[:-3])))
    with pytest.raises(warc_zstd.ArchiveError):
        warc_zstd.parse_record(records[0].replace(b"Content-Length: 3", b"Content-Length: 4"))
    with pytest.raises(warc_zstd.ArchiveError):
        list(warc_zstd.read_archive(io.BytesIO(b"\x28\xb5\x2f\xfd0000")))


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 3])
    scores, step, start = rng.normal(size=(8, 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    got, _ = crf_language.forward_backward(scores, sizes, step, start)
    at = 0
    for n in (5, 3):
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            v = np.exp(start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            for i in range(n):
                want[i, y[i]] += v
        assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_kd_tree_search_is_exact():
    rng = np.random.default_rng(5)
    points, queries = np.floor(rng.normal(size=(3000, 6)) * 20), np.floor(rng.normal(size=(20, 6)) * 20)
    best = [kd_search.Best(5) for _ in range(20)]
    for half in (slice(0, 1700), slice(1700, 3000)):
        kd_search.search(kd_search.Tree(np.arange(3000)[half], points[half]), np.arange(20), queries, best)
    for q in range(20):
        scores = points @ queries[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert [(-s, i) for s, i in zip(best[q].scores.tolist(), best[q].ids.tolist(), strict=True)] == want


def test_sets_and_prefixes():
    column = pa.array(["a b c d e f a b c d e", None, "", " \n ", "One two", "one  TWO"])
    sets = {}
    for first, n, rows, tokens in ngram_join.token_sets(column):
        for r in range(n):
            sets[first + r] = tokens[rows == r].tolist()
    assert [len(sets[i]) for i in range(6)] == [6, 0, 0, 0, 1, 1] and sets[4] == sets[5]
    for n in range(1, 60):
        assert ngram_join.prefix_length(n) == n - (4 * n + 4) // 5 + 1
    tokens = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 999).astype(np.uint64))
    assert (ngram_join.unpack(ngram_join.pack(tokens)) == tokens).all()


def test_lines_and_sentences():
    raw = "  One line \n\n\ttwo\nthree".encode()
    starts, ends, row, number = fuzzy_lines.line_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"One line", b"two", b"three"] and number.tolist() == [0, 2, 3]
    raw = "One two. Three!  Four? five 1.5 six\n\nSeven.".encode()
    starts, ends, _, words = sentence_spans.sentences(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["One two.", "Three!", "Four?", "five 1.5 six", "Seven."]
    assert words.tolist() == [2, 1, 1, 3, 1]


def test_lines_at_the_threshold_share_a_band():
    rng = np.random.default_rng(11)
    mates, lines = [], []
    while len(mates) < 2000:
        line = rng.integers(97, 123, rng.integers(100, 1000), dtype=np.uint8)
        n = len(line) - fuzzy_lines.SHINGLE + 1
        cut = n // 5  # a head less: Jaccard (n - cut) / n, just over 0.8
        mates.append((len(lines), len(lines) + 1))
        lines += [line, line[cut:]]
    ends = np.cumsum([len(x) for x in lines])
    owner, marks, _ = fuzzy_lines.shingles(np.concatenate(lines), ends - [len(x) for x in lines], ends)
    keys = fuzzy_lines.bands(fuzzy_lines.signatures(owner, marks, len(lines)))
    a, b = np.array(mates).T
    assert (keys[a] == keys[b]).any(axis=1).mean() >= 0.9995


def test_any_repeated_51_words_share_a_span():
    rng = np.random.default_rng(5)

    def prose(n):
        stop = rng.random(n) < rng.choice([0.0, 0.02, 0.08, 0.3])
        return [f"w{w}" + "." * int(s) for w, s in zip(rng.integers(0, 10**6, n), stop, strict=True)]

    for _ in range(300):
        passage = prose(51)
        found = []
        for _ in range(2):
            raw = " ".join(prose(rng.integers(1, 60)) + passage + prose(rng.integers(1, 60))).encode()
            _, _, _, h1, h2 = sentence_spans.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            found.append(set(zip(h1.tolist(), h2.tolist(), strict=True)))
        assert found[0] & found[1]


def test_phrases_and_proximity_in_a_shard():
    docs = ["the cat sat on the mat", "cat the sat", None, "on the mat the cat"]
    terms = phrase_index.Queries([("q", "the cat sat on mat")]).terms
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([7, 8, 9, 10]), pa.array(docs)], names=["row", "key", "text"])
    row = next(phrase_index.index_rows([batch], terms, 10))
    shard = phrase_index.Shard(*(row.column(i)[0].values.to_numpy() for i in range(2, 6)), 10)
    one = lambda text: next(phrase_index.words_of(pa.array([text])))[1].tolist()
    assert shard.doc(shard.phrase(one("the cat"))).tolist() == [0, 3]
    assert shard.doc(shard.phrase(one("on the mat"))).tolist() == [0, 3]
    assert not len(shard.phrase(one("mat cat"))) and not len(shard.phrase(one("dog")))
    assert set(shard.doc(shard.proximity(one("cat mat"), 3)).tolist()) == {3}


def test_sketches_never_differ_in_more_places_than_the_sets():
    r = np.random.default_rng(5)
    for n in (3, 80, 900):
        base = r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        for k in (0, 1, n // 9, n // 2):
            other = np.concatenate([base[k:], r.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64)])
            rows, both = np.repeat([0, 1], n), np.concatenate([base, other])
            for odd in (False, True):
                a, b = bit_sketches(rows, both, 2, 8, odd)
                assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= len(set(base.tolist()) ^ set(other.tolist()))


def test_lean_gives_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    left = []

    def run(batches):
        held = [np.ones(12_000) for _ in range(3000)]  # small enough for the heap, the last one above the others
        left.append(held[-1])
        yield from batches

    before = resident()
    assert list(lean(run)([1, 2])) == [1, 2]
    assert resident() - before < 100 << 20


def test_line_spans_by_plain_code():
    random = np.random.default_rng(3)
    rows = [bytes(random.choice(np.frombuffer(b"ab \t\r\n\n", np.uint8), n)) for n in random.integers(0, 40, 300)] + [b"", b"\n", b" \n "]
    offs = np.cumsum([0, *map(len, rows)])
    starts, ends, row, number = fuzzy_lines.line_spans(np.frombuffer(b"".join(rows), np.uint8), offs)
    got = [(r, k, b"".join(rows)[a:b]) for r, k, a, b in zip(row.tolist(), number.tolist(), starts.tolist(), ends.tolist(), strict=True)]
    strip = b" \t\x0b\x0c\r"
    assert got == [(r, k, x.strip(strip)) for r, raw in enumerate(rows) for k, x in enumerate(raw.split(b"\n")) if x.strip(strip)]
