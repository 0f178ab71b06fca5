"""Registered queries of the llm operators (whole tables, production parameters)
and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayscope.llm import bpe_prefix, crf_language, fill_middle, filter_audit, fuzzy_lines, kd_search, markov_secrets, mph_tokens, ngram_join, phrase_index, polytope_search, sentence_spans, warc_zstd
from strayscope.llm.common import prepare, table

BYTE_BPE, WORD_BPE, END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 2


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe_prefix.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc_zstd.archive_round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS head FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id > head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > head THEN head END AS refers_to
FROM f"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mph_tokens.token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
        FROM d, sizes, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS r(i)),
hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.p = win.p AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op4_bpe_encode_decode": op4_bpe_encode_decode,
    "op7_warc_zstd": op7_warc_zstd,
    "op8_token_files": op8_token_files,
    "op10_decontamination": op10_decontamination,
}

ORACLES: dict[str, str] = {
    "op7_warc_zstd": OP7_SQL,
    "op10_decontamination": OP10_SQL,
}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM low, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.r)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.r) AS component_id
FROM c LEFT JOIN n USING (doc_id) GROUP BY c.doc_id"""

QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join
ORACLES["op1_ngram_jaccard_join"] = OP1_SQL


def op2_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = sentence_spans.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "source_ids", F.col("text").alias("clean_text"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fuzzy_lines.line_report(table(spark, sf_dir, "documents"))


QUERIES |= {"op2_kd_top_k": op2_kd_top_k, "op3_sentence_spans": op3_sentence_spans, "op5_fuzzy_lines": op5_fuzzy_lines}
ORACLES["op2_kd_top_k"] = OP2_SQL


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return markov_secrets.secret_report(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return crf_language.language_report(table(spark, sf_dir, "documents"))


QUERIES |= {"op6_secret_scan": op6_secret_scan, "op9_language_id": op9_language_id}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS head FROM t),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > head THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
p AS (SELECT '' AS o UNION ALL SELECT o || f FROM p, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE NOT contains(o, f)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS f, CAST(1 << (ascii(o[k]) - 65) AS INTEGER) AS bit,
             CAST(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(o[j]) - 65))) AS INTEGER) AS before
      FROM p, unnest(range(1, 6)) AS u(k) WHERE len(o) = 5),
r AS (SELECT part, filter_order, step, f,
             sum(CASE WHEN mask & (coalesce(before, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & coalesce(before, 0) = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r"""


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return polytope_search.nearest(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fill_middle.digests(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a + 1:b], ''), '') AS mid,
             coalesce(array_to_string(w[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(len(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

QUERIES |= {"op11_filter_audit": op11_filter_audit, "op12_cross_polytope": op12_cross_polytope, "op13_fill_in_middle": op13_fill_in_middle}
ORACLES |= {"op11_filter_audit": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
