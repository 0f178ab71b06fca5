"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: all-pairs work is a plain SQL cross
join here, which is fine for a small-fixture oracle and is exactly what the
Spark plans avoid.  Outputs are rounded to 6 decimals like the Spark side.
"""

from __future__ import annotations

VEC = """
e AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
         CASE WHEN label IN (8, 9) THEN 'oos' ELSE CAST(label AS VARCHAR) END AS intent,
         CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
  FROM embeddings),
tr AS (SELECT id, v, intent FROM e WHERE split = 'train' AND intent <> 'oos'),
q AS (SELECT id, v, intent, split, CAST(intent = 'oos' AS INTEGER) AS y FROM e WHERE split <> 'train')"""

# centroid head over the training rows: softmax(10 * cos(x, centroid))
HEAD = """
trn AS (SELECT id, intent, v, sqrt(greatest(list_sum(list_transform(v, lambda y: y * y)), 1e-12)) AS nr FROM tr),
tlong AS (SELECT intent, UNNEST(list_transform(v, lambda x: x / nr)) AS x,
                 UNNEST(generate_series(1, len(v))) AS pos FROM trn),
cavg AS (SELECT intent, pos, avg(x) AS m FROM tlong GROUP BY intent, pos),
cnrm AS (SELECT intent, pos, m / sqrt(greatest(sum(m * m) OVER (PARTITION BY intent), 1e-12)) AS c FROM cavg),
cent AS (SELECT intent AS cls, list(c ORDER BY pos) AS c FROM cnrm GROUP BY intent),
hz AS (SELECT q.id, q.split, q.y, q.intent, cent.cls,
              10.0 * list_inner_product(q.v, cent.c) / sqrt(list_sum(list_transform(q.v, lambda y: y * y))) AS z
       FROM q, cent),
hp AS (SELECT id, split, y, intent, cls, z, exp(z - max(z) OVER (PARTITION BY id)) AS ez FROM hz),
probs AS (SELECT id, split, y, intent, cls, z, ez / sum(ez) OVER (PARTITION BY id) AS p,
                 z - max(z) OVER (PARTITION BY id) - ln(sum(ez) OVER (PARTITION BY id)) AS logp FROM hp)"""


def bench_sql(lower: bool, levels=(0.95, 0.90)) -> str:
    """Six benchmark metrics from ``sc(id, split, y, score)``."""
    cmp = "score < t" if lower else "score > t"
    adj = "-score" if lower else "score"
    fprs, sel = [], []
    for lv in levels:
        nm = f"fpr_{int(round(lv * 100))}"
        fprs.append(f"""{nm} AS (
  SELECT (({lv} - (tp - pos) / P) * (fp / N) + (tp / P - {lv}) * ((fp - neg) / N)) / (tp / P - (tp - pos) / P) AS {nm}
  FROM cum, tot WHERE tp / P >= {lv} ORDER BY s DESC LIMIT 1)""")
        sel.append(f"round({nm}, 6) AS {nm}")
    return f"""
vs AS (SELECT score, y FROM sc WHERE split = 'val' AND score IS NOT NULL),
ts AS (SELECT score, y FROM sc WHERE split = 'test' AND score IS NOT NULL),
bnd AS (SELECT min(score) - 0.1 AS lo, max(score) + 0.1 AS hi FROM vs),
th AS (SELECT r.i, CASE WHEN r.i = 99 THEN hi ELSE lo + r.i * ((hi - lo) / 99.0) END AS t
       FROM bnd, range(100) r(i)),
cm AS (SELECT th.i, th.t,
         CAST(count(*) FILTER (WHERE vs.y = 1 AND {cmp}) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE vs.y = 0 AND {cmp}) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE vs.y = 1 AND NOT ({cmp})) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE vs.y = 0 AND NOT ({cmp})) AS DOUBLE) AS tn
       FROM th, vs GROUP BY th.i, th.t),
mc AS (SELECT i, t, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
         THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc FROM cm),
best AS (SELECT t FROM mc ORDER BY mcc DESC, i LIMIT 1),
tc AS (SELECT
         CAST(count(*) FILTER (WHERE ts.y = 1 AND {cmp}) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE ts.y = 0 AND {cmp}) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE ts.y = 1 AND NOT ({cmp})) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE ts.y = 0 AND NOT ({cmp})) AS DOUBLE) AS tn
       FROM ts, best),
lab AS (SELECT CASE WHEN 2.0 * tp + fn + fp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0.0 END AS f1,
               CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
                 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc
        FROM tc),
{roc_sql(adj)},
{",".join(fprs)}
SELECT {", ".join(sel)}, round(rk.aupr, 6) AS aupr, round(rk.auroc, 6) AS auroc,
       round(lab.f1, 6) AS f1, round(lab.mcc, 6) AS mcc
FROM {", ".join(f"fpr_{int(round(lv * 100))}" for lv in levels)}, rk, lab"""


def roc_sql(adj: str = "score", src: str = "ts") -> str:
    return f"""
adj AS (SELECT {adj} AS s, y FROM {src}),
grp AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM adj GROUP BY s),
cum AS (SELECT s, pos, neg,
          sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM grp),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM grp),
rk AS (SELECT sum(pos * tp / (tp + fp)) / max(P) AS aupr,
              sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS auroc FROM cum, tot)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


KNN_SC = """
sc AS (SELECT q.id, q.split, q.y, min(list_distance(q.v, tr.v)) AS score FROM q, tr GROUP BY q.id, q.split, q.y)"""

COS_SC = """
sc AS (SELECT q.id, q.split, q.y, max(list_cosine_similarity(q.v, tr.v)) AS score FROM q, tr GROUP BY q.id, q.split, q.y)"""

CENTRE = """
mlong AS (SELECT UNNEST(v) AS x, UNNEST(generate_series(1, len(v))) AS pos FROM tr),
mu AS (SELECT list(m ORDER BY pos) AS mu FROM (SELECT pos, avg(x) AS m FROM mlong GROUP BY pos)),
trc AS (SELECT tr.id, tr.intent, list_transform(tr.v, lambda x, i: x - mu.mu[i]) AS v FROM tr, mu),
qc AS (SELECT q.id, q.split, q.y, list_transform(q.v, lambda x, i: x - mu.mu[i]) AS v FROM q, mu)"""

PCA_COS_SC = """
sc AS (SELECT qc.id, qc.split, qc.y, max(list_cosine_similarity(qc.v, trc.v)) AS score FROM qc, trc
       GROUP BY qc.id, qc.split, qc.y)"""

PCA_EUC_SC = """
sc AS (SELECT qc.id, qc.split, qc.y, min(list_distance(qc.v, trc.v)) AS score FROM qc, trc
       GROUP BY qc.id, qc.split, qc.y)"""


def entropy_sc(qv: str = "q", tv: str = "tr") -> str:
    return f"""
sims AS (SELECT a.id, a.split, a.y, b.id AS rid, list_cosine_similarity(a.v, b.v) AS s FROM {qv} a, {tv} b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, rid) AS rn FROM sims),
topz AS (SELECT id, max(s) FILTER (WHERE rn = 1) AS top, sum(exp(s)) - exp(max(s) FILTER (WHERE rn = 1)) AS z
         FROM ranked GROUP BY id),
terms AS (SELECT r.id, r.split, r.y, t.top,
            CASE WHEN r.rn = 1 THEN 0.0 ELSE ((1 - t.top) * exp(r.s) / t.z) * ln((1 - t.top) * exp(r.s) / t.z + 1e-6) END AS pl
          FROM ranked r JOIN topz t ON r.id = t.id),
sc AS (SELECT id, split, y, -(max(top) * ln(max(top) + 1e-6) + sum(pl)) AS score FROM terms GROUP BY id, split, y)"""


LOF_SC = """
tp AS (SELECT a.id AS qid, b.id AS rid, greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(a.v, b.v))) AS d
       FROM tr a, tr b WHERE a.id <> b.id),
tnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rk FROM tp) WHERE rk <= 10),
kd AS (SELECT qid AS rid, max(d) AS kdist FROM tnn GROUP BY qid),
lrd AS (SELECT tnn.qid AS rid, 1.0 / (avg(greatest(kd.kdist, tnn.d)) + 1e-10) AS lrd
        FROM tnn JOIN kd ON tnn.rid = kd.rid GROUP BY tnn.qid),
qp AS (SELECT q.id, q.split, q.y, tr.id AS rid, greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(q.v, tr.v))) AS d
       FROM q, tr),
qnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS rk FROM qp) WHERE rk <= 10),
sc AS (SELECT qnn.id, qnn.split, qnn.y,
              1.5 - avg(lrd.lrd) / (1.0 / (avg(greatest(kd.kdist, qnn.d)) + 1e-10)) AS score
       FROM qnn JOIN kd ON qnn.rid = kd.rid JOIN lrd ON qnn.rid = lrd.rid GROUP BY qnn.id, qnn.split, qnn.y)"""

TRUST_SC = """
pr AS (SELECT q.id, q.split, q.y, tr.intent AS cls, list_distance(q.v, tr.v) AS d FROM q, tr),
rkd AS (SELECT *, row_number() OVER (PARTITION BY id, cls ORDER BY d) AS r,
               count(*) OVER (PARTITION BY id, cls) AS n FROM pr),
pc AS (SELECT id, split, y, cls, d FROM rkd WHERE r = least(2, n)),
pr2 AS (SELECT pc.*, hpred.pred FROM pc JOIN hpred ON pc.id = hpred.id),
sc AS (SELECT id, split, y, min(d) FILTER (WHERE cls <> pred) / (min(d) FILTER (WHERE cls = pred) + 1e-12) AS score
       FROM pr2 GROUP BY id, split, y)"""

HEAD_PRED = """
hpred AS (SELECT id, split, y, intent, cls AS pred, p AS prob FROM
          (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) AS rn FROM probs) WHERE rn = 1)"""

ENTROPY_HEAD_SC = """
sc AS (SELECT id, split, y, -sum(p * ln(p + 1e-6)) AS score FROM probs GROUP BY id, split, y)"""
MSP_SC = """
sc AS (SELECT id, split, y, max(p) AS score FROM probs GROUP BY id, split, y)"""
DOC_SC = """
sc AS (SELECT id, split, y, max(1.0 / (1.0 + exp(-z))) AS score FROM probs GROUP BY id, split, y)"""
MSP_SCORE_SC = """
sc AS (SELECT id, split, y, 1.0 - max(p) AS score FROM probs GROUP BY id, split, y)"""
ENTROPY_SCORE_SC = """
sc AS (SELECT id, split, y, -sum(p * logp) AS score FROM probs GROUP BY id, split, y)"""

CLASS_MEAN = """
clong AS (SELECT intent, UNNEST(v) AS x, UNNEST(generate_series(1, len(v))) AS pos FROM tr),
cmean AS (SELECT intent AS cls, list(m ORDER BY pos) AS m FROM
          (SELECT intent, pos, avg(x) AS m FROM clong GROUP BY intent, pos) GROUP BY intent)"""

CLASS_EUC_SC = """
sc AS (SELECT q.id, q.split, q.y,
              min(list_sum(list_transform(q.v, lambda x, i: (x - cmean.m[i]) * (x - cmean.m[i])))) AS score
       FROM q, cmean GROUP BY q.id, q.split, q.y)"""

ADB = """
pts AS (SELECT id, intent, list_transform(v, lambda x: x / nr) AS u FROM trn),
pd AS (SELECT cent.cls, pts.intent, list_distance(pts.u, cent.c) AS d FROM pts, cent),
rs AS (SELECT cls, sum(d) FILTER (WHERE intent = cls) AS s_id, count(*) FILTER (WHERE intent = cls) AS n_id,
              sum(d) FILTER (WHERE intent <> cls) AS s_ood, count(*) FILTER (WHERE intent <> cls) AS n_ood
       FROM pd GROUP BY cls),
rad AS (SELECT cls, CASE WHEN n_ood = 0 THEN 2.0 ELSE least(2.0, floor(
          (s_ood + s_id * (n_ood / n_id) / 0.75) / (n_ood * (1.0 + 1.0 / 0.75)) / 0.01) * 0.01) END AS radius FROM rs),
qn AS (SELECT id, split, y, list_transform(v, lambda x: x / sqrt(greatest(list_sum(list_transform(v, lambda z: z * z)), 1e-12))) AS u
       FROM q),
qd AS (SELECT qn.id, qn.split, qn.y, cent.cls, list_distance(qn.u, cent.c) AS d FROM qn, cent),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cls) AS rn FROM qd) WHERE rn = 1),
apred AS (SELECT near.id, near.split, near.y, CASE WHEN near.d < rad.radius THEN near.cls ELSE 'oos' END AS pred, near.d
          FROM near JOIN rad ON near.cls = rad.cls)"""


def label_metrics_sql(src: str, ycol: str = "y", pcol: str = "is_ood_pred") -> str:
    return f""",
lc AS (SELECT CAST(count(*) FILTER (WHERE {ycol} = 1 AND {pcol}) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE {ycol} = 0 AND {pcol}) AS DOUBLE) AS fp,
              CAST(count(*) FILTER (WHERE {ycol} = 1 AND NOT {pcol}) AS DOUBLE) AS fn,
              CAST(count(*) FILTER (WHERE {ycol} = 0 AND NOT {pcol}) AS DOUBLE) AS tn FROM {src})
SELECT round(CASE WHEN 2.0 * tp + fn + fp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0
         THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END, 6) AS mcc
FROM lc"""


# ------------------------------------------------------------------ text
UTT = r"""
u0 AS (SELECT doc_id, lang, UNNEST(regexp_split_to_array(text, '[.\n]+')) AS raw,
              UNNEST(generate_series(0, len(regexp_split_to_array(text, '[.\n]+')) - 1)) AS pos FROM documents),
ut AS (SELECT doc_id * 2147483648 + pos AS id, trim(raw) AS text,
              CASE WHEN lang = 'es' THEN 'oos' ELSE lang END AS intent,
              CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
       FROM u0 WHERE length(trim(raw)) > 0)"""


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def rake_sql() -> str:
    from ..functions.text import KEYWORD_STOPWORDS, RAKE_STOPWORDS
    return rf"""
rt AS (SELECT id, intent, split, regexp_extract_all(
         regexp_replace(regexp_replace(lower(CASE WHEN regexp_matches(text, '\S*https?:\/\/.*[\r\n]*') THEN '' ELSE text END),
                        '\S*[a-zA-Z0-9+_.-]+@[a-zA-Z0-9.-]+\S*', '', 'g'), '\p{{Nd}}', '', 'g'),
         '[\p{{L}}\p{{N}}_]+') AS toks0 FROM ut),
rt2 AS (SELECT id, intent, split, CAST(intent = 'oos' AS INTEGER) AS y,
               toks0 AS toks FROM rt),
ph AS (SELECT DISTINCT trim(p) AS phrase FROM (
         SELECT UNNEST(string_split(array_to_string(list_transform(toks, lambda w:
                  CASE WHEN list_contains({_sql_list(RAKE_STOPWORDS)}, w) THEN chr(1) ELSE w END), ' '), chr(1))) AS p
         FROM rt2 WHERE split = 'train' AND intent <> 'oos') WHERE length(trim(p)) > 0),
phn AS (SELECT phrase, len(string_split(phrase, ' ')) AS n_words FROM ph),
mw AS (SELECT DISTINCT UNNEST(string_split(phrase, ' ')) AS w FROM phn WHERE n_words > 1),
kw0 AS (SELECT phrase, n_words FROM phn WHERE n_words > 1
        UNION ALL SELECT phrase, n_words FROM phn WHERE n_words = 1 AND phrase IN (SELECT w FROM mw)),
kw AS (SELECT phrase, n_words FROM kw0 WHERE NOT list_contains({_sql_list(KEYWORD_STOPWORDS)}, phrase))"""


RAKE_PRED = """
tt AS (SELECT id, y, toks FROM rt2 WHERE split = 'test'),
grams AS (SELECT tt.id, array_to_string(tt.toks[s:s + L.n - 1], ' ') AS g
          FROM tt, (SELECT DISTINCT n_words AS n FROM kw) L, unnest(range(1, len(tt.toks) + 1)) r(s) WHERE s + L.n - 1 <= len(tt.toks)),
hits AS (SELECT DISTINCT id FROM grams WHERE g IN (SELECT phrase FROM kw)),
rpred AS (SELECT tt.id, tt.y, tt.id NOT IN (SELECT id FROM hits) AS is_ood_pred FROM tt)"""

TOK = r"""
tk AS (SELECT id, intent, split, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM ut),
trt AS (SELECT * FROM tk WHERE split = 'train' AND intent <> 'oos'),
vc AS (SELECT w AS word, count(*) AS cnt FROM (SELECT UNNEST(toks) AS w FROM trt) GROUP BY w),
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, word) + 4 AS INTEGER) AS idx, cnt FROM vc)"""

ENC = """
enc AS (SELECT tk.id, tk.split, tk.intent, CAST(p.pos - 1 AS INTEGER) AS pos, coalesce(vocab.idx, 3) AS token_id
        FROM (SELECT id, split, intent, UNNEST(toks) AS w, UNNEST(generate_series(1, len(toks))) AS pos FROM tk) p
        JOIN tk ON tk.id = p.id LEFT JOIN vocab ON vocab.word = p.w)"""

BOW = r"""
bw AS (SELECT id, split, intent, UNNEST(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM ut)"""


MC_DROPOUT_SC = """
mcm AS (SELECT q.id, q.split, q.y, r.r, list_transform(q.v, lambda x, i:
          CASE WHEN (((((q.id % 2147483647) * 48271 + r.r * 69621 + (i - 1) * 40692) % 2147483647) * 1583458089 + 12345)
                     % 2147483647)::DOUBLE / 2147483647::DOUBLE >= 0.35::DOUBLE
               THEN x * (1.0::DOUBLE / (1.0::DOUBLE - 0.35::DOUBLE)) ELSE 0.0::DOUBLE END) AS v
        FROM q, range(15) r(r)),
mz AS (SELECT mcm.id, mcm.split, mcm.y, mcm.r, cent.cls,
              10.0 * list_inner_product(mcm.v, cent.c) / sqrt(list_sum(list_transform(mcm.v, lambda t: t * t))) AS z
       FROM mcm, cent),
mp AS (SELECT id, split, y, r, cls, exp(z - max(z) OVER (PARTITION BY id, r)) AS ez FROM mz),
mp2 AS (SELECT id, split, y, r, cls, ez / sum(ez) OVER (PARTITION BY id, r) AS p FROM mp),
sc AS (SELECT id, split, y, max(mp3) AS score FROM
       (SELECT id, split, y, cls, avg(p) AS mp3 FROM mp2 GROUP BY id, split, y, cls) GROUP BY id, split, y)"""


BNN_BOOT_SC = """
bu AS (SELECT tr.id, tr.intent, r.r, list_transform(tr.v, lambda x: x / sqrt(greatest(list_sum(list_transform(tr.v, lambda y: y * y)), 1e-12))) AS u0,
              (((((tr.id % 2147483647) * 48271 + r.r * 69621) % 2147483647) * 1583458089 + 12345) % 2147483647)::DOUBLE / 2147483647::DOUBLE AS u
       FROM tr, range(15) r(r)),
bw AS (SELECT id, intent, r, u0, (CASE WHEN u >= 0.36787944117144233::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.7357588823428847::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9196986029286058::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9810118431238463::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9963401531726563::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9994058151824183::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.999916758850712::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9999897508033253::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.999998874797402::DOUBLE THEN 1 ELSE 0 END) + (CASE WHEN u >= 0.9999998885745216::DOUBLE THEN 1 ELSE 0 END) AS w FROM bu),
bl AS (SELECT r, intent, w, UNNEST(u0) AS x, UNNEST(generate_series(1, len(u0))) AS pos FROM bw WHERE w > 0),
bs AS (SELECT r, intent, pos, sum(w * x) / sum(w) AS m FROM bl GROUP BY r, intent, pos),
bn AS (SELECT r, intent, pos, m / sqrt(greatest(sum(m * m) OVER (PARTITION BY r, intent), 1e-12)) AS c FROM bs),
bc AS (SELECT r, intent AS cls, list(c ORDER BY pos) AS c FROM bn GROUP BY r, intent),
bz AS (SELECT q.id, q.split, q.y, bc.r, bc.cls, 10.0 * list_inner_product(q.v, bc.c) / sqrt(list_sum(list_transform(q.v, lambda t: t * t))) AS z FROM q, bc),
be AS (SELECT id, split, y, r, cls, exp(z - max(z) OVER (PARTITION BY id, r)) AS ez FROM bz),
bp AS (SELECT id, split, y, r, cls, ez / sum(ez) OVER (PARTITION BY id, r) AS p FROM be),
sc AS (SELECT id, split, y, max(mp) AS score FROM (SELECT id, split, y, cls, avg(p) AS mp FROM bp GROUP BY id, split, y, cls) GROUP BY id, split, y)"""


CONV_EMB = r"""
ct AS (SELECT conv_id * 2147483648 + turn AS id, text, CASE WHEN role = 'system' THEN 'oos' ELSE role END AS intent,
              CASE WHEN conv_id % 5 < 3 THEN 'train' WHEN conv_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
       FROM conversations),
tk AS (SELECT id, intent, split, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM ct),
trt AS (SELECT * FROM tk WHERE split = 'train' AND intent <> 'oos'),
vc AS (SELECT w AS word, count(*) AS cnt FROM (SELECT UNNEST(toks) AS w FROM trt) GROUP BY w),
vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, word) + 4 AS INTEGER) AS idx FROM vc
          UNION ALL SELECT '[BOS]', 1 UNION ALL SELECT '[EOS]', 2 UNION ALL SELECT '[UNK]', 3 UNION ALL SELECT '[SEP]', 4),
wv AS (SELECT idx, list_transform(range(0, 16), lambda j:
          sqrt(-2.0 * ln(((('0x' || substr(md5(concat_ws('/', 0, word, j, 'a')), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))
          * cos(2.0 * 3.141592653589793 * ((('0x' || substr(md5(concat_ws('/', 0, word, j, 'b')), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE)
          * 0.3836) AS vec FROM vocab),
enc AS (SELECT p.id, coalesce(vocab.idx, 3) AS token_id
        FROM (SELECT id, UNNEST(toks) AS w FROM tk) p LEFT JOIN vocab ON vocab.word = p.w),
pl AS (SELECT enc.id, wv.vec FROM enc JOIN wv ON wv.idx = enc.token_id),
pe AS (SELECT id, UNNEST(vec) AS x, UNNEST(generate_series(1, 16)) AS j FROM pl),
emb AS (SELECT id, list(m ORDER BY j) AS v FROM (SELECT id, j, avg(x) AS m FROM pe GROUP BY id, j) GROUP BY id),
e AS (SELECT ct.id, emb.v, ct.intent, ct.split FROM ct JOIN emb ON ct.id = emb.id),
tr AS (SELECT id, v, intent FROM e WHERE split = 'train' AND intent <> 'oos'),
q AS (SELECT id, v, intent, split, CAST(intent = 'oos' AS INTEGER) AS y FROM e WHERE split <> 'train')"""


# ------------------------------------------------------------ Mahalanobis family
NEWTON_STEPS = 40


def inverse_sql(name: str, steps: int = NEWTON_STEPS) -> str:
    """``inv(i, j, v)``: the (pseudo-)inverse of the symmetric matrix ``name(i, j, v)`` by Newton's
    iteration x <- 2x - x c x, which starts at c divided by its largest row sum squared."""
    parts = [f"nx0 AS MATERIALIZED (SELECT i, j, v / (SELECT max(s) * max(s) FROM (SELECT sum(abs(v)) AS s FROM {name} GROUP BY i)) AS v FROM {name})"]
    for k in range(steps):
        parts.append(f"np{k} AS MATERIALIZED (SELECT c.i, x.j, sum(c.v * x.v) AS v FROM {name} c JOIN nx{k} x ON c.j = x.i GROUP BY c.i, x.j)")
        parts.append(f"nq{k} AS MATERIALIZED (SELECT x.i, p.j, sum(x.v * p.v) AS v FROM nx{k} x JOIN np{k} p ON x.j = p.i GROUP BY x.i, p.j)")
        parts.append(f"nx{k + 1} AS MATERIALIZED (SELECT i, j, 2 * x.v - q.v AS v FROM nx{k} x JOIN nq{k} q USING (i, j))")
    return ",\n".join(parts) + f",\ninv AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM nx{steps} GROUP BY i))"


def mahalanobis_sql(by_class: bool, ddof: int, root: bool, nearest: bool = False) -> str:
    """sc(id, split, y, score): (squared) Mahalanobis distance to the mean, or to the class
    means (``nearest``: to the mean that is nearest by Euclidean distance)."""
    group = "intent" if by_class else "''"
    value = "list_sum(list_transform(inv.m, lambda r, i: d[i] * list_dot_product(r, d)))"
    if nearest:  # residuals are centred on their own mean again
        cut, pick = ", sum(x) / (SELECT count(*) FROM tr) AS c", "arg_min(score, e)"
    else:
        cut, pick = ", 0.0 AS c", "min(score)"
    return f"""
ml AS (SELECT id, {group} AS g, UNNEST(v) AS x, UNNEST(generate_series(1, len(v))) AS pos FROM tr),
mm AS (SELECT g, pos, avg(x) AS m FROM ml GROUP BY g, pos),
ms AS (SELECT g, list(m ORDER BY pos) AS m FROM mm GROUP BY g),
mr AS (SELECT id, pos, x - m AS x FROM ml JOIN mm USING (g, pos)),
mz AS (SELECT pos{cut} FROM mr GROUP BY pos),
mx AS (SELECT id, pos, x - c AS x FROM mr JOIN mz USING (pos)),
zs AS (SELECT list(c ORDER BY pos) AS z FROM mz),
cv AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / ((SELECT count(*) FROM tr) - {ddof}) AS v FROM mx a JOIN mx b USING (id) GROUP BY a.pos, b.pos),
{inverse_sql("cv")},
df AS (SELECT q.id, q.split, q.y, list_transform(q.v, lambda x, i: x - ms.m[i]) AS r,
              list_transform(q.v, lambda x, i: x - ms.m[i] - zs.z[i]) AS d FROM q, ms, zs),
sv AS (SELECT id, split, y, list_dot_product(r, r) AS e, {value} AS score FROM df, inv),
sc AS (SELECT id, split, any_value(y) AS y, {f"sqrt(greatest({pick}, 0))" if root else pick} AS score FROM sv GROUP BY id, split)"""
