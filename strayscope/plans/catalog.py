"""Registered queries (Spark side) and their oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame computed over the
whole given tables.  Oracles live in :mod:`oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import likelihood as LR
from ..operators import metrics as M
from ..operators import subwords as SW
from ..operators import vectors as V
from ..sources import fixtures as FX
from . import benchmark as B
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _bench(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.round_cols(B.benchmark(D.get_detector(name), FX.vector_splits(spark, sf_dir)))
    return q


# ------------------------------------------------------- detector benchmarks

for _name, _sql in {
    "knn": O.with_(O.VEC, O.KNN_SC, O.bench_sql(False)),
    "euclidean_nn": O.with_(O.VEC, O.KNN_SC, O.bench_sql(False)),
    "cosine_nn": O.with_(O.VEC, O.COS_SC, O.bench_sql(True)),
    "cosine_entropy": O.with_(O.VEC, O.entropy_sc(), O.bench_sql(False)),
    "pca_cosine": O.with_(O.VEC, O.CENTRE, O.PCA_COS_SC, O.bench_sql(True)),
    "pca_euclidean": O.with_(O.VEC, O.CENTRE, O.PCA_EUC_SC, O.bench_sql(False)),
    "pca_entropy": O.with_(O.VEC, O.CENTRE, O.entropy_sc("qc", "trc"), O.bench_sql(False)),
    "lof": O.with_(O.VEC, O.LOF_SC, O.bench_sql(True)),
    "trust_score": O.with_(O.VEC, O.HEAD, O.HEAD_PRED, O.TRUST_SC, O.bench_sql(True)),
    "entropy": O.with_(O.VEC, O.HEAD, O.ENTROPY_HEAD_SC, O.bench_sql(False)),
    "msp": O.with_(O.VEC, O.HEAD, O.MSP_SC, O.bench_sql(True)),
    "doc": O.with_(O.VEC, O.HEAD, O.DOC_SC, O.bench_sql(True)),
    "class_euclidean": O.with_(O.VEC, O.CLASS_MEAN, O.CLASS_EUC_SC, O.bench_sql(False)),
    "maha": O.with_(O.VEC, O.mahalanobis_sql(False, 1, True), O.bench_sql(False)),
    "class_maha": O.with_(O.VEC, O.mahalanobis_sql(True, 0, False), O.bench_sql(False)),
    "class_maha_pca": O.with_(O.VEC, O.mahalanobis_sql(True, 1, False, nearest=True), O.bench_sql(False)),
    "marginal_maha": O.with_(O.VEC, O.mahalanobis_sql(False, 0, False), O.bench_sql(False)),
    "marginal_maha_pca": O.with_(O.VEC, O.mahalanobis_sql(False, 1, False), O.bench_sql(False)),
    "mc_dropout": None,
}.items():
    register(f"bench_{_name}", _sql)(_bench(_name))


@register("bench_msp_score", O.with_(O.VEC, O.HEAD, O.MSP_SCORE_SC, O.bench_sql(False)))
def bench_msp_score(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    head = D.CentroidHead().fit(sp.train)
    val = B.with_labels(D.logits_msp_score(sp.val, head), sp.val).checkpoint()
    test = B.with_labels(D.logits_msp_score(sp.test, head), sp.test).checkpoint()
    return B.round_cols(M.benchmark_scores(test, val, outdomain_is_lower=False))


@register("bench_entropy_score", O.with_(O.VEC, O.HEAD, O.ENTROPY_SCORE_SC, O.bench_sql(False)))
def bench_entropy_score(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    head = D.CentroidHead().fit(sp.train)
    val = B.with_labels(D.logits_entropy_score(sp.val, head), sp.val).checkpoint()
    test = B.with_labels(D.logits_entropy_score(sp.test, head), sp.test).checkpoint()
    return B.round_cols(M.benchmark_scores(test, val, outdomain_is_lower=False))


@register("bench_adb", O.with_(O.VEC, O.HEAD, O.ADB, """
tst AS (SELECT y, pred = 'oos' AS is_ood_pred FROM apred WHERE split = 'test')""" + O.label_metrics_sql("tst")))
def bench_adb(spark, sf_dir):
    return B.round_cols(B.benchmark_adb(FX.vector_splits(spark, sf_dir)))


@register("adb_radius", O.with_(O.VEC, O.HEAD, O.ADB) + """
SELECT cls AS intent, round(radius, 6) AS radius FROM rad""")
def adb_radius(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return B.round_cols(V.adb_radius(sp.train, V.class_centroids(sp.train)))


@register("adb_predict", O.with_(O.VEC, O.HEAD, O.ADB) + """
SELECT id, pred, round(d, 6) AS dist FROM apred""")
def adb_predict(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    q = sp.val.unionByName(sp.test)
    return B.round_cols(D.ADB().fit(sp.train).predict(q))


# ----------------------------------------------------------- vector operators

@register("knn_scores", O.with_(O.VEC, """
sc AS (SELECT q.id, min(list_distance(q.v, tr.v)) AS score FROM q, tr GROUP BY q.id)
SELECT id, round(score, 6) AS score FROM sc"""))
def knn_scores(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return B.round_cols(D.KNN().fit(sp.train).score(sp.val.unionByName(sp.test)))


@register("nn_label_lookup", O.with_(O.VEC, """
sims AS (SELECT q.id, tr.id AS rid, tr.intent, list_cosine_similarity(q.v, tr.v) AS s FROM q, tr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, rid) AS rn FROM sims) WHERE rn = 1)
SELECT id, intent AS pred, round(s, 6) AS sim FROM best"""))
def nn_label_lookup(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return B.round_cols(D.nn_label_lookup(sp.val.unionByName(sp.test), sp.train))


@register("per_class_kth_neighbor", O.with_(O.VEC, """
pr AS (SELECT q.id, tr.intent AS cls, list_distance(q.v, tr.v) AS d FROM q, tr WHERE q.split = 'test'),
rkd AS (SELECT *, row_number() OVER (PARTITION BY id, cls ORDER BY d) AS r, count(*) OVER (PARTITION BY id, cls) AS n FROM pr)
SELECT id, cls, round(d, 6) AS d FROM rkd WHERE r = least(2, n)"""))
def per_class_kth_neighbor(spark, sf_dir):
    from ..operators.pairs import NearestOp, pair_scan
    sp = FX.vector_splits(spark, sf_dir)
    nn = pair_scan(sp.test, sp.train, NearestOp(2, "l2", by_class=True), label_col="intent")
    return B.round_cols(nn.groupBy(F.col("qid").alias("id"), "cls").agg(F.max_by("value", "rank").alias("d")))


@register("knn_rank", O.with_(O.VEC, """
qp AS (SELECT q.id, tr.id AS ref_id, greatest(0.0, least(2.0, 1.0 - list_cosine_similarity(q.v, tr.v))) AS d
       FROM q, tr WHERE q.split = 'test'),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, ref_id) AS rank FROM qp)
SELECT id, CAST(rank AS INTEGER) AS rank, ref_id, round(d, 6) AS value FROM rk WHERE rank <= 10"""))
def knn_rank(spark, sf_dir):
    from ..operators.pairs import NearestOp, pair_scan
    sp = FX.vector_splits(spark, sf_dir)
    nn = pair_scan(sp.test, sp.train, NearestOp(10, "cosine_dist"))
    return B.round_cols(nn.select(F.col("qid").alias("id"), "rank", "ref_id", "value"))


@register("class_centroids", """
WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT label, v, sqrt(greatest(list_sum(list_transform(v, lambda y: y * y)), 1e-12)) AS nr FROM e),
l AS (SELECT label, UNNEST(list_transform(v, lambda x: x / nr)) AS x, UNNEST(generate_series(0, len(v) - 1)) AS pos FROM n),
a AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY label, pos)
SELECT CAST(label AS VARCHAR) AS intent, CAST(pos AS INTEGER) AS pos,
       round(m / sqrt(greatest(sum(m * m) OVER (PARTITION BY label), 1e-12)), 6) AS value FROM a""")
def class_centroids(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings")
    df = e.select(F.col("label").cast("string").alias("intent"),
                  F.col("embedding").cast("array<double>").alias("v"))
    return B.round_cols(V.class_centroids(df))


@register("class_means", """
WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT label, UNNEST(v) AS x, UNNEST(generate_series(0, len(v) - 1)) AS pos FROM e)
SELECT CAST(label AS VARCHAR) AS intent, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS value FROM l GROUP BY label, pos""")
def class_means(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings")
    df = e.select(F.col("label").cast("string").alias("intent"),
                  F.col("embedding").cast("array<double>").alias("v"))
    return B.round_cols(V.class_vector_means(df))


@register("covariance", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT vec_id, UNNEST(v) AS x, UNNEST(generate_series(0, len(v) - 1)) AS pos FROM e)
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov
FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""")
def covariance(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    _, cov, _ = V.covariance(e, ddof=1)
    return B.round_cols(V.covariance_long(cov, spark))


@register("covariance_pooled", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT vec_id, label, UNNEST(v) AS x, UNNEST(generate_series(0, len(v) - 1)) AS pos FROM e),
c AS (SELECT vec_id, pos, x - avg(x) OVER (PARTITION BY label, pos) AS r FROM l)
SELECT CAST(a.pos AS INTEGER) AS i, CAST(b.pos AS INTEGER) AS j, round(sum(a.r * b.r) / count(*), 6) AS cov
FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY a.pos, b.pos""")
def covariance_pooled(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("intent"), F.col("embedding").cast("array<double>").alias("v"))
    keys, mat = V.collect_matrix(V.class_vector_means(e), "intent")
    cov, _ = V.pooled_class_covariance(e, dict(zip(keys, mat)), ddof=0)
    return B.round_cols(V.covariance_long(cov, spark))


@register("nearest_centroid", O.with_(O.VEC, O.HEAD, """
d AS (SELECT q.id, cent.cls, list_distance(q.v, cent.c) AS de,
             1.0 - list_cosine_similarity(q.v, cent.c) AS dc,
             acos(greatest(-1.0, least(1.0, list_cosine_similarity(q.v, cent.c)))) / pi() AS da FROM q, cent),
e1 AS (SELECT id, cls AS pred_euclidean, de FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY de, cls) rn FROM d) WHERE rn = 1),
c1 AS (SELECT id, cls AS pred_cosine, dc FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dc, cls) rn FROM d) WHERE rn = 1),
a1 AS (SELECT id, cls AS pred_angular, da FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY da, cls) rn FROM d) WHERE rn = 1)
SELECT e1.id, pred_euclidean, round(de, 6) AS d_euclidean, pred_cosine, round(dc, 6) AS d_cosine,
       pred_angular, round(da, 6) AS d_angular
FROM e1 JOIN c1 ON e1.id = c1.id JOIN a1 ON e1.id = a1.id"""))
def nearest_centroid(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return B.round_cols(V.nearest_centroid(sp.val.unionByName(sp.test), V.class_centroids(sp.train)))


# ------------------------------------------------------------ metric queries

def _knn_scored(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    det = D.KNN().fit(sp.train)
    return (B.score_split(det, sp.val), B.score_split(det, sp.test))


@register("roc_points", O.with_(O.VEC, O.KNN_SC, """
ts AS (SELECT score, y FROM sc WHERE split = 'test')""", O.roc_sql()) + """
SELECT round(s, 6) AS score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cum""")
def roc_points(spark, sf_dir):
    _, test = _knn_scored(spark, sf_dir)
    return B.round_cols(M.roc_points(test))


@register("threshold_curve", O.with_(O.VEC, O.KNN_SC, O.bench_sql(False).split("\nbest AS")[0].rstrip(",")) + """
SELECT CAST(cm.i AS INTEGER) AS i, round(cm.t, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 1.25 * tp + 0.25 * fn + fp > 0 THEN 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) ELSE 0.0 END, 6) AS f05,
       round(CASE WHEN 2.0 * tp + fn + fp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN 3.25 * tp + 2.25 * fn + fp > 0 THEN 3.25 * tp / (3.25 * tp + 2.25 * fn + fp) ELSE 0.0 END, 6) AS f15,
       round(mc.mcc, 6) AS mcc
FROM cm JOIN mc ON cm.i = mc.i""")
def threshold_curve(spark, sf_dir):
    val, _ = _knn_scored(spark, sf_dir)
    return B.round_cols(M.threshold_curve(val, outdomain_is_lower=False))


def _step_fpr_sql(prefix: str, lv: float) -> str:
    return f"""
{prefix}f AS (SELECT fp / N AS v FROM {prefix}cum, {prefix}tot WHERE tp / P >= {lv} ORDER BY s DESC LIMIT 1)"""


def _roc_named(prefix: str, adj: str, yexpr: str) -> str:
    return f"""
{prefix}adj AS (SELECT {adj} AS s, {yexpr} AS y FROM ts),
{prefix}grp AS (SELECT s, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) - sum(y) AS DOUBLE) AS neg FROM {prefix}adj GROUP BY s),
{prefix}cum AS (SELECT s, pos, neg,
          sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM {prefix}grp),
{prefix}tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM {prefix}grp),
{prefix}rk AS (SELECT sum(pos * tp / (tp + fp)) / max(P) AS aupr,
              sum(neg * (tp - pos / 2.0)) / (max(P) * max(N)) AS auroc FROM {prefix}cum, {prefix}tot),
{prefix}95 AS (SELECT fp / N AS v FROM {prefix}cum, {prefix}tot WHERE tp / P >= 0.95 ORDER BY s DESC LIMIT 1),
{prefix}90 AS (SELECT fp / N AS v FROM {prefix}cum, {prefix}tot WHERE tp / P >= 0.9 ORDER BY s DESC LIMIT 1)"""


@register("ood_metrics", O.with_(O.VEC, O.KNN_SC, """
ts AS (SELECT score, y FROM sc WHERE split = 'test')""", _roc_named("o", "score", "y"), _roc_named("n", "-score", "1 - y")) + """
SELECT round(o95.v, 6) AS ood_fpr95, round(o90.v, 6) AS ood_fpr90, round(ork.aupr, 6) AS ood_aupr,
       round(ork.auroc, 6) AS auroc, round(n95.v, 6) AS in_fpr95, round(n90.v, 6) AS in_fpr90,
       round(nrk.aupr, 6) AS in_aupr
FROM o95, o90, ork, n95, n90, nrk""")
def ood_metrics(spark, sf_dir):
    _, test = _knn_scored(spark, sf_dir)
    return B.round_cols(M.ood_metrics(test))


@register("ood_accuracy", O.with_(O.VEC, O.KNN_SC, """
ts AS (SELECT score, y FROM sc WHERE split = 'test'),
md AS (SELECT median(score) AS t FROM sc WHERE split = 'val')""") + """
SELECT round(avg(CASE WHEN (score >= t) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS ood_accuracy FROM ts, md""")
def ood_accuracy(spark, sf_dir):
    val, test = _knn_scored(spark, sf_dir)
    t = float(val.agg(F.median("score")).first()[0])
    return B.round_cols(M.ood_accuracy(test, t))


@register("classification_metrics", O.with_(O.VEC, O.HEAD, O.HEAD_PRED, """
idp AS (SELECT intent, pred FROM hpred WHERE intent <> 'oos'),
pc AS (SELECT intent AS t, pred AS q, count(*) AS c FROM idp GROUP BY ALL),
lbl AS (SELECT t AS label FROM pc UNION SELECT q FROM pc),
per AS (SELECT label,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE t = label AND q = label), 0) AS DOUBLE) AS tp,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE q = label), 0) AS DOUBLE) AS npred,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE t = label), 0) AS DOUBLE) AS support FROM lbl),
agg AS (SELECT sum(tp) AS tp, sum(npred - tp) AS fp, sum(support - tp) AS fn,
               avg(CASE WHEN 2 * tp + (npred - tp) + (support - tp) > 0
                        THEN 2.0 * tp / (2 * tp + (npred - tp) + (support - tp)) ELSE 0.0 END) AS f1_macro,
               sum(support) AS n FROM per)""") + """
SELECT round(tp / n, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
       round(CASE WHEN 2.0 * tp + fn + fp > 0 THEN 2.0 * tp / (2.0 * tp + fn + fp) ELSE 0.0 END, 6) AS f1_micro FROM agg""")
def classification_metrics(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    head = D.CentroidHead().fit(sp.train)
    q = sp.val.unionByName(sp.test).filter(F.col("intent") != FX.OOD_LABEL)
    pred = head.predict(q).join(q.select("id", "intent"), "id")
    return B.round_cols(M.classification_metrics(pred))


@register("weighted_report", O.with_(O.VEC, O.HEAD, O.HEAD_PRED, """
idp AS (SELECT intent, pred FROM hpred WHERE intent <> 'oos'),
pc AS (SELECT intent AS t, pred AS q, count(*) AS c FROM idp GROUP BY ALL),
lbl AS (SELECT t AS label FROM pc UNION SELECT q FROM pc),
per AS (SELECT label,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE t = label AND q = label), 0) AS DOUBLE) AS tp,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE q = label), 0) AS DOUBLE) AS np,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE t = label), 0) AS DOUBLE) AS sup FROM lbl),
rep AS (SELECT sum(CASE WHEN np > 0 THEN tp / np ELSE 0.0 END * sup) / sum(sup) AS precision,
               sum(CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END * sup) / sum(sup) AS recall,
               sum(CASE WHEN np + sup > 0 THEN 2.0 * tp / (np + sup) ELSE 0.0 END * sup) / sum(sup) AS f1,
               sum(sup) AS support, sum(tp) AS c, sum(sup) AS s, sum(sup * np) AS tps, sum(np * np) AS pp,
               sum(sup * sup) AS tt FROM per)""") + """
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support,
       round(CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - tps) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0.0 END, 6) AS mcc
FROM rep""")
def weighted_report(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    head = D.CentroidHead().fit(sp.train)
    q = sp.val.unionByName(sp.test).filter(F.col("intent") != FX.OOD_LABEL)
    pred = head.predict(q).join(q.select("id", "intent"), "id")
    return B.round_cols(M.weighted_report(pred))


# --------------------------------------------------------------------- text
from ..functions import text as TXT  # noqa: E402
from ..operators import text as TO  # noqa: E402


def _utt(spark, sf_dir, ood_in_train=False):
    return FX.utterance_splits(spark, sf_dir, ood_in_train)


@register("text_clean", O.with_(O.UTT, O.rake_sql()) + """
SELECT id, CASE WHEN len(toks) > 0 THEN array_to_string(toks, ' ') || ' ' ELSE '' END AS cleaned FROM rt2""")
def text_clean(spark, sf_dir):
    u = FX.utterance_table(spark, sf_dir)
    return u.select("id", TXT.rake_text(TXT.rake_tokens(F.col("text"))).alias("cleaned"))


@register("rake_keywords", O.with_(O.UTT, O.rake_sql()) + """
SELECT phrase, CAST(n_words AS INTEGER) AS n_words FROM kw""")
def rake_keywords(spark, sf_dir):
    return TO.rake_keywords(_utt(spark, sf_dir).train)


@register("bench_rake", O.with_(O.UTT, O.rake_sql(), O.RAKE_PRED) + O.label_metrics_sql("rpred"))
def bench_rake(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    pred = TO.RakeDetector().fit(sp.train).predict(sp.test)
    return B.round_cols(B.benchmark_labels(pred, sp.test))


@register("vocab_build", O.with_(O.UTT, O.TOK) + """
SELECT word, idx, cnt FROM vocab""")
def vocab_build(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    return TO.vocab_build(sp.train, TXT.default_tokenizer(F.col("text")))


@register("vocab_encode", O.with_(O.UTT, O.TOK, O.ENC) + """
SELECT id, pos, token_id FROM enc WHERE split = 'test'""")
def vocab_encode(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    vocab = TO.vocab_build(sp.train, TXT.default_tokenizer(F.col("text")))
    return TO.vocab_encode(sp.test, vocab, TXT.default_tokenizer(F.col("text")))


@register("bag_of_words", O.with_(O.UTT, O.BOW) + """
, tv AS (SELECT DISTINCT token FROM bw WHERE split = 'train' AND intent <> 'oos')
SELECT id, token, count(*) AS cnt FROM bw WHERE split = 'test' AND token IN (SELECT token FROM tv) GROUP BY id, token""")
def bag_of_words(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    return TO.bag_of_words(sp.test, TO.bow_vocabulary(sp.train))


@register("tf_idf", O.with_(O.UTT, O.BOW) + """
, ntr AS (SELECT count(*) AS n FROM ut WHERE split = 'train' AND intent <> 'oos'),
dfs AS (SELECT token, count(DISTINCT id) AS df FROM bw WHERE split = 'train' AND intent <> 'oos' GROUP BY token),
idf AS (SELECT token, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM dfs, ntr),
tf AS (SELECT id, token, count(*) AS cnt FROM bw WHERE split = 'test' GROUP BY id, token),
w AS (SELECT tf.id, tf.token, tf.cnt * idf.idf AS w FROM tf JOIN idf ON tf.token = idf.token)
SELECT id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def tf_idf(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    return B.round_cols(TO.tfidf_transform(sp.test, TO.tfidf_fit(sp.train)))


# --------------------------------------------------------------------- prep
from ..operators import prep as P  # noqa: E402

VEC_ALL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN label IN (8, 9) THEN 'oos' ELSE CAST(label AS VARCHAR) END AS intent,
         CASE WHEN vec_id % 5 < 3 THEN 'train' WHEN vec_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
  FROM embeddings),
tr AS (SELECT id, intent FROM e WHERE split = 'train' AND intent <> 'oos')"""

MD5U = "(('0x' || substr(md5(concat_ws('/', {parts})), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def _folds_sql(k: int = 5) -> str:
    def upto(m, i):
        return f"(CASE WHEN {m} >= {i} THEN floor(({m} - {i}) / {k}) + 1 ELSE 0 END)"
    allocs = [f"({upto('s + n - 1', i)} - {upto('s - 1', i)})" for i in range(k)]
    cums = [" + ".join(allocs[: i + 1]) for i in range(k)]
    fold = " + ".join(f"(CASE WHEN {c} <= r THEN 1 ELSE 0 END)" for c in cums)
    return VEC_ALL + f""",
c AS (SELECT intent, count(*) AS n, min(id) AS first_id FROM e GROUP BY intent),
co AS (SELECT intent, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
r AS (SELECT e.id, co.n, co.s, row_number() OVER (PARTITION BY e.intent ORDER BY e.id) - 1 AS r FROM e JOIN co USING (intent))
SELECT id, CAST({fold} AS INTEGER) AS fold FROM r"""


@register("stratified_folds", _folds_sql())
def stratified_folds(spark, sf_dir):
    return P.stratified_folds(FX.vector_table(spark, sf_dir))


@register("class_weights", VEC_ALL + """,
c AS (SELECT intent, count(*) AS n FROM tr GROUP BY intent),
t AS (SELECT sum(n) AS total, count(*) AS k FROM c)
SELECT intent, n, round(total::DOUBLE / (k * n), 6) AS w_balanced,
       round(greatest(ln((0.35 * total)::DOUBLE / n), 0.65), 6) AS w_log FROM c, t""")
def class_weights(spark, sf_dir):
    return B.round_cols(P.class_weights(FX.vector_splits(spark, sf_dir).train))


def _powerset_sql(ratio: float) -> str:
    return f"""
WITH c AS (SELECT CAST(label AS VARCHAR) AS cls, count(*) AS n FROM embeddings GROUP BY 1),
co AS (SELECT cls, n, row_number() OVER (ORDER BY cls) - 1 AS b FROM c),
tot AS (SELECT sum(n) AS total, count(*) AS k FROM c),
masks AS (SELECT UNNEST(range(0, (SELECT 1 << k FROM tot))) AS mask),
m AS (SELECT masks.mask, co.cls, co.n, (masks.mask >> co.b) & 1 AS bit FROM masks, co),
g AS (SELECT mask, sum(n * bit) AS n_rows,
             coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (WHERE bit = 1), '') AS classes,
             coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (WHERE bit = 0), '') AS complement FROM m GROUP BY mask)
SELECT CAST(mask AS BIGINT) AS mask, CAST(n_rows AS BIGINT) AS n_rows, classes, complement FROM g, tot
WHERE n_rows >= (1.0::DOUBLE - 0.15::DOUBLE) * {ratio}::DOUBLE * total::DOUBLE
  AND n_rows <= (1.0::DOUBLE + 0.15::DOUBLE) * {ratio}::DOUBLE * total::DOUBLE"""


def _powerset_query(ratio: float) -> Query:
    def q(spark, sf_dir):
        e = FX.read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("intent"))
        return P.open_set_splits(e, ratio)
    return q


register("open_set_splits_25", _powerset_sql(0.25))(_powerset_query(0.25))
register("open_set_splits_75", _powerset_sql(0.75))(_powerset_query(0.75))


@register("label_index", VEC_ALL + """,
ci AS (SELECT intent, CAST(row_number() OVER (ORDER BY intent) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT intent FROM tr))
SELECT e.id, coalesce(ci.idx, -1) AS label_idx FROM e LEFT JOIN ci USING (intent) WHERE e.split <> 'train'""")
def label_index(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return P.label_index(sp.val.unionByName(sp.test), sp.train)


@register("feasible_val_filter", VEC_ALL + """
SELECT id, intent FROM e WHERE split = 'val' AND intent IN (SELECT intent FROM tr)""")
def feasible_val_filter(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return P.feasible_filter(sp.val, sp.train).select("id", "intent")


@register("mark_in_domain", """
SELECT vec_id AS id, CASE WHEN CAST(label AS VARCHAR) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN 0 ELSE 1 END AS is_ood
FROM embeddings""")
def mark_in_domain(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"),
                                                          F.col("label").cast("string").alias("intent"))
    return P.mark_in_domain(e, [str(i) for i in range(8)]).select("id", "is_ood")


@register("class_counts", VEC_ALL + """
SELECT split, intent, count(*) AS n FROM e GROUP BY split, intent""")
def class_counts(spark, sf_dir):
    return P.class_counts(FX.vector_table(spark, sf_dir), by=("split",))


@register("dataset_sizes", O.with_(O.UTT) + """
SELECT split, count(*) FILTER (WHERE intent = 'oos') AS n_ood, count(*) FILTER (WHERE intent <> 'oos') AS n_indomain
FROM ut GROUP BY split""")
def dataset_sizes(spark, sf_dir):
    u = FX.utterance_table(spark, sf_dir)
    return u.groupBy("split").agg(F.count_if(F.col("intent") == FX.OOD_LABEL).alias("n_ood"),
                                  F.count_if(F.col("intent") != FX.OOD_LABEL).alias("n_indomain"))


@register("duplicate_singletons", O.with_(O.UTT) + r""",
fw AS (SELECT id, regexp_extract(lower(text), '[\p{L}\p{N}_]+') AS intent FROM ut),
s AS (SELECT intent FROM fw GROUP BY intent HAVING count(*) = 1)
SELECT id, intent FROM fw UNION ALL SELECT id, intent FROM fw WHERE intent IN (SELECT intent FROM s)""")
def duplicate_singletons(spark, sf_dir):
    u = FX.utterance_table(spark, sf_dir)
    fw = u.select("id", F.regexp_extract(F.lower("text"), r"[\p{L}\p{N}_]+", 0).alias("intent"))
    return P.duplicate_singletons(fw)


@register("sample_pairs", VEC_ALL + f""",
c AS (SELECT intent, count(*) AS n FROM tr GROUP BY intent),
co AS (SELECT intent, n, coalesce(sum(n) OVER (ORDER BY intent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
tot AS (SELECT sum(n) AS total FROM c),
rk AS (SELECT tr.id, co.n, co.s, row_number() OVER (ORDER BY tr.intent, tr.id) - 1 AS g FROM tr JOIN co USING (intent)),
w AS (SELECT id, s + floor({MD5U.format(parts="0, id, 'pos'")} * n) AS pos_g,
             floor({MD5U.format(parts="0, id, 'neg'")} * (total - n)) AS j, n, s, total FROM rk, tot),
w2 AS (SELECT id, pos_g, CASE WHEN total - n > 0 THEN CASE WHEN j >= s THEN j + n ELSE j END END AS neg_g FROM w)
SELECT w2.id, rk.id AS partner_id, 1.0::DOUBLE AS target FROM w2 JOIN rk ON rk.g = w2.pos_g
UNION ALL
SELECT w2.id, rk.id AS partner_id, 0.0::DOUBLE AS target FROM w2 JOIN rk ON rk.g = w2.neg_g""")
def sample_pairs(spark, sf_dir):
    return P.sample_pairs(FX.vector_splits(spark, sf_dir).train)


@register("weighted_sample", VEC_ALL + f""",
c AS (SELECT intent, count(*) AS n FROM tr GROUP BY intent),
co AS (SELECT intent, n, row_number() OVER (ORDER BY intent) - 1 AS cls_order,
              coalesce(sum(n) OVER (ORDER BY intent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c),
tot AS (SELECT sum(n) AS total, count(*) AS k FROM c),
rk AS (SELECT tr.id, row_number() OVER (ORDER BY tr.intent, tr.id) - 1 AS g FROM tr),
d AS (SELECT r.draw, floor({MD5U.format(parts="0, r.draw, 'class'")} * tot.k) AS cls_order,
             {MD5U.format(parts="0, r.draw, 'row'")} AS u FROM tot, range(0, (SELECT CAST(total AS BIGINT) FROM tot)) r(draw)),
d2 AS (SELECT d.draw, co.s + floor(d.u * co.n) AS g FROM d JOIN co ON co.cls_order = d.cls_order)
SELECT d2.draw, rk.id FROM d2 JOIN rk ON rk.g = d2.g""")
def weighted_sample(spark, sf_dir):
    return P.weighted_sample(FX.vector_splits(spark, sf_dir).train)


@register("cross_corpus", """
WITH x AS (SELECT doc_id AS id, lang AS intent, 'documents' AS corpus FROM documents
           UNION ALL SELECT item_id, 'oos', 'benchmark' FROM benchmark)
SELECT corpus, intent, count(*) AS n FROM x GROUP BY corpus, intent""")
def cross_corpus(spark, sf_dir):
    return FX.cross_corpus_table(spark, sf_dir).groupBy("corpus", "intent").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- likelihood ratio
LR_P_NOISE = 0.1


def _lr_sql(noise: str = "uniform", utterances: str = O.UTT) -> str:
    if noise == "uniform":
        cumulated, pick = "", f"""CAST(floor({MD5U.format(parts="0, id, pos, 'word'")} * nw) + 5 AS INTEGER)"""
    else:  # the word whose share of the running total holds the draw
        weight = {"unigram": "cnt", "uniroot": "CAST(floor(sqrt(cnt) * 1048576) AS BIGINT)"}[noise]
        cumulated = f"""wt AS (SELECT idx, CAST({weight} AS HUGEINT) AS w, sum(CAST({weight} AS HUGEINT)) OVER (ORDER BY idx) AS upto FROM vocab),
ends AS (SELECT list(upto ORDER BY idx) AS ends, CAST(max(upto) AS DOUBLE) AS total FROM wt),
dr AS (SELECT id, pos, CAST(floor(('0x' || substr(md5(concat_ws('/', 0, id, pos, 'word')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE * total) AS HUGEINT) AS at
       FROM enc, ends WHERE split = 'train' AND intent <> 'oos'),
drawn AS (SELECT dr.id AS did, dr.pos AS dpos, wt.idx AS didx FROM dr ASOF JOIN (SELECT idx, upto - w AS start FROM wt) wt ON dr.at >= wt.start),
"""
        pick = "(SELECT didx FROM drawn WHERE did = id AND dpos = pos)"
    return O.with_(utterances, O.TOK, O.ENC, f"""
nv AS (SELECT count(*) AS nw FROM vocab),
{cumulated}tren AS (SELECT id, pos, token_id FROM enc WHERE split = 'train' AND intent <> 'oos'),
teen AS (SELECT id, pos, token_id FROM enc WHERE split = 'test'),
noisy AS (SELECT id, pos, CASE WHEN token_id >= 5 AND {MD5U.format(parts="0, id, pos, 'noise'")} < {LR_P_NOISE}
            THEN {pick} ELSE token_id END AS token_id
          FROM tren, nv),
bi_tr AS (SELECT id, pos, coalesce(lag(token_id) OVER (PARTITION BY id ORDER BY pos), 1) AS prev, token_id AS tok
          FROM (SELECT id, pos, token_id FROM tren UNION ALL SELECT id, max(pos) + 1, 2 FROM tren GROUP BY id)),
bi_bg AS (SELECT id, pos, coalesce(lag(token_id) OVER (PARTITION BY id ORDER BY pos), 1) AS prev, token_id AS tok
          FROM (SELECT id, pos, token_id FROM noisy UNION ALL SELECT id, max(pos) + 1, 2 FROM noisy GROUP BY id)),
bi_te AS (SELECT id, pos, coalesce(lag(token_id) OVER (PARTITION BY id ORDER BY pos), 1) AS prev, token_id AS tok
          FROM (SELECT id, pos, token_id FROM teen UNION ALL SELECT id, max(pos) + 1, 2 FROM teen GROUP BY id)),
p_tr AS (SELECT prev, tok, count(*) AS c FROM bi_tr GROUP BY prev, tok),
c_tr AS (SELECT prev, count(*) AS c FROM bi_tr GROUP BY prev),
p_bg AS (SELECT prev, tok, count(*) AS c FROM bi_bg GROUP BY prev, tok),
c_bg AS (SELECT prev, count(*) AS c FROM bi_bg GROUP BY prev),
V AS (SELECT (nw + 5)::DOUBLE AS v FROM nv),
lp AS (SELECT b.id, b.pos,
         ln((coalesce(p1.c, 0) + 1.0::DOUBLE) / (coalesce(c1.c, 0) + V.v)) AS lp_in,
         ln((coalesce(p2.c, 0) + 1.0::DOUBLE) / (coalesce(c2.c, 0) + V.v)) AS lp_bg
       FROM bi_te b CROSS JOIN V
       LEFT JOIN p_tr p1 ON p1.prev = b.prev AND p1.tok = b.tok LEFT JOIN c_tr c1 ON c1.prev = b.prev
       LEFT JOIN p_bg p2 ON p2.prev = b.prev AND p2.tok = b.tok LEFT JOIN c_bg c2 ON c2.prev = b.prev),
sc AS (SELECT lp.id, round(-(CAST(sum(CAST(round((lp_in - lp_bg) * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12), 9) AS score
       FROM lp GROUP BY lp.id),
ts AS (SELECT sc.score, CAST(ut.intent = 'oos' AS INTEGER) AS y FROM sc JOIN ut ON sc.id = ut.id)""",
                                              O.roc_sql()) + """,
f95 AS (SELECT fp / N AS v FROM cum, tot WHERE tp / P >= 0.95 ORDER BY s DESC LIMIT 1),
f90 AS (SELECT fp / N AS v FROM cum, tot WHERE tp / P >= 0.9 ORDER BY s DESC LIMIT 1)
SELECT round(f95.v, 6) AS fpr95, round(f90.v, 6) AS fpr90, round(rk.aupr, 6) AS aupr, round(rk.auroc, 6) AS auroc
FROM f95, f90, rk"""


for _name, _noise in (("bench_likelihood_ratio", "uniform"), ("bench_likelihood_ratio_unigram", "unigram"), ("bench_likelihood_ratio_uniroot", "uniroot")):
    register(_name, _lr_sql(_noise))(lambda spark, sf_dir, _noise=_noise: _lr_bench(_utt, _noise)(spark, sf_dir))


@register("bench_binary_msp", O.with_(O.VEC.replace(
    "tr AS (SELECT id, v, intent FROM e WHERE split = 'train' AND intent <> 'oos')",
    "tr AS (SELECT id, v, CASE WHEN intent = 'oos' THEN 'true' ELSE 'false' END AS intent FROM e WHERE split = 'train')"),
    O.HEAD, """
sc AS (SELECT id, split, y, max(p) FILTER (WHERE cls = 'true') AS score FROM probs GROUP BY id, split, y)""",
    O.bench_sql(False)))
def bench_binary_msp(spark, sf_dir):
    splits = FX.vector_splits(spark, sf_dir, ood_in_train=True)
    return B.round_cols(B.benchmark(D.BinaryMSP(), splits))


@register("cv_centroid_head")
def cv_centroid_head(spark, sf_dir, n_splits: int = 5):
    """Stratified k-fold CV of the centroid head: accuracy, macro F1 and
    multi-class MCC per fold, then mean and population std over folds."""
    tr = FX.vector_splits(spark, sf_dir).train
    folds = P.stratified_folds(tr, n_splits).join(tr, "id").checkpoint()
    per_fold = None
    for f in range(n_splits):  # one small fit per fold (n_splits jobs)
        fit, ev = folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)
        pred = D.CentroidHead().fit(fit).predict(ev).join(ev.select("id", "intent"), "id")
        m = M._one_row_zip(M.classification_metrics(pred), M.multiclass_mcc(pred)).withColumn("fold", F.lit(f))
        per_fold = m if per_fold is None else per_fold.unionByName(m)
    return B.round_cols(M.cv_mean_std(per_fold, ["accuracy", "f1_macro", "mcc"]))


# ------------------------------------------------------------ trust filters
from ..operators import trust as TR  # noqa: E402

TRUST_ALPHA = 0.1


@register("trust_density_filter", O.with_(O.VEC, f"""
pr AS (SELECT a.id, a.intent, list_distance(a.v, b.v) AS d FROM tr a JOIN tr b ON a.intent = b.intent),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS r, count(*) OVER (PARTITION BY id) AS n FROM pr),
rad AS (SELECT id, intent, d AS radius FROM rk WHERE r = least(10, n)),
o AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY radius) - 1 AS r0,
             count(*) OVER (PARTITION BY intent) AS n FROM rad),
hh AS (SELECT intent, {1 - TRUST_ALPHA} * (max(n) - 1) AS h FROM o GROUP BY intent),
ep AS (SELECT o.intent, min(radius) FILTER (WHERE r0 = floor(h)) AS a, max(radius) FILTER (WHERE r0 = ceil(h)) AS b,
              max(h - floor(h)) AS t FROM o JOIN hh ON o.intent = hh.intent GROUP BY o.intent)""") + """
SELECT rad.id FROM rad JOIN ep ON rad.intent = ep.intent WHERE rad.radius <= ep.a + (ep.b - ep.a) * ep.t""")
def trust_density_filter(spark, sf_dir):
    return TR.density_filter(FX.vector_splits(spark, sf_dir).train, TRUST_ALPHA).select("id")


@register("trust_uncertainty_filter", O.with_(O.VEC, f"""
pr AS (SELECT a.id, a.intent AS own, b.intent, b.id AS rid, list_distance(a.v, b.v) AS d FROM tr a, tr b),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, rid) AS r FROM pr) WHERE r <= 10),
sh AS (SELECT id, count(*) FILTER (WHERE intent = own) / count(*) AS share FROM rk GROUP BY id),
o AS (SELECT *, row_number() OVER (ORDER BY share) - 1 AS r0, count(*) OVER () AS n FROM sh),
hh AS (SELECT {TRUST_ALPHA} * (max(n) - 1) AS h FROM o),
ep AS (SELECT min(share) FILTER (WHERE r0 = floor(h)) AS a, max(share) FILTER (WHERE r0 = ceil(h)) AS b,
              max(h - floor(h)) AS t FROM o, hh)""") + """
SELECT sh.id FROM sh, ep WHERE sh.share >= ep.a + (ep.b - ep.a) * ep.t""")
def trust_uncertainty_filter(spark, sf_dir):
    return TR.uncertainty_filter(FX.vector_splits(spark, sf_dir).train, TRUST_ALPHA).select("id")


@register("gaussian_nb_predict", O.with_(O.VEC, """
lg AS (SELECT intent, UNNEST(v) AS x, UNNEST(generate_series(1, len(v))) AS pos FROM tr),
st AS (SELECT intent AS cls, pos, avg(x) AS m, var_pop(x) AS s2 FROM lg GROUP BY intent, pos),
eps AS (SELECT 1e-9 * max(g) AS e FROM (SELECT pos, var_pop(x) AS g FROM lg GROUP BY pos)),
pri AS (SELECT intent AS cls, ln(count(*) / (SELECT count(*) FROM tr)) AS lp FROM tr GROUP BY intent),
ql AS (SELECT id, UNNEST(v) AS x, UNNEST(generate_series(1, len(v))) AS pos FROM q),
jll AS (SELECT ql.id, st.cls,
               sum(-0.5 * ln(2 * pi() * (st.s2 + eps.e)) - 0.5 * (ql.x - st.m) * (ql.x - st.m) / (st.s2 + eps.e)) AS j
        FROM ql JOIN st ON ql.pos = st.pos CROSS JOIN eps GROUP BY ql.id, st.cls),
jp AS (SELECT jll.id, jll.cls, jll.j + pri.lp AS j FROM jll JOIN pri ON jll.cls = pri.cls),
pe AS (SELECT id, cls, j, exp(j - max(j) OVER (PARTITION BY id)) AS ez FROM jp),
pp AS (SELECT id, cls, ez / sum(ez) OVER (PARTITION BY id) AS p,
              row_number() OVER (PARTITION BY id ORDER BY j DESC, cls) AS rn FROM pe)""") + """
SELECT id, cls AS pred, round(p, 6) AS prob FROM pp WHERE rn = 1""")
def gaussian_nb_predict(spark, sf_dir):
    sp = FX.vector_splits(spark, sf_dir)
    return B.round_cols(D.GaussianNB().fit(sp.train).predict(sp.val.unionByName(sp.test)))

register("bench_bnn_bootstrap", O.with_(O.VEC, O.BNN_BOOT_SC, O.bench_sql(True)))(_bench("bnn_bootstrap"))


def conversation_vectors(spark, sf_dir, dim: int = 16) -> FX.Splits:
    """conversations -> bag-of-word-vectors embeddings (vocabulary from the
    training split, deterministic random word vectors) -> vector splits."""
    c = FX.short_text_table(spark, sf_dir)
    train_rows = c.filter((F.col("split") == "train") & (F.col("intent") != FX.OOD_LABEL))
    emb = TO.text_embeddings(c, train_rows, dim)
    e = c.join(emb, "id").select("id", "v", "intent", "split").checkpoint()  # encoded once, reused by every split
    return FX._three(e, False)


@register("text_embeddings", O.with_(O.CONV_EMB) + """
SELECT id, CAST(j - 1 AS INTEGER) AS pos, round(v[j], 6) AS value FROM e, range(1, 17) r(j)""")
def text_embeddings_q(spark, sf_dir):
    c = FX.short_text_table(spark, sf_dir)
    train_rows = c.filter((F.col("split") == "train") & (F.col("intent") != FX.OOD_LABEL))
    emb = TO.text_embeddings(c, train_rows, 16)
    return B.round_cols(emb.select("id", F.posexplode("v").alias("pos", "value"))
                        .select("id", F.col("pos").cast("int").alias("pos"), "value"))


@register("bench_knn_conversations", O.with_(O.CONV_EMB, O.KNN_SC, O.bench_sql(False)))
def bench_knn_conversations(spark, sf_dir):
    return B.round_cols(B.benchmark(D.KNN(), conversation_vectors(spark, sf_dir)))


@register("sweep_vector_grid")
def sweep_vector_grid(spark, sf_dir):
    from .sweep import run_sweep
    return run_sweep(spark, sf_dir)


@register("bench_rake_enhanced")
def bench_rake_enhanced(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    kw = TO.rake_keywords_enhanced(sp.train, lambda phrases: SW.fitted_terms(sp.train, phrases)).checkpoint()
    pred = TO.rake_predict(sp.test, kw)
    return B.round_cols(B.benchmark_labels(pred, sp.test))


REFERENCE_DIM = 100  # fixed value: columns of the reference's word vectors


@register("similar_terms")
def similar_terms_q(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    return SW.fitted_terms(sp.train, TO.all_phrases(sp.train), dim=REFERENCE_DIM)


# ------------------------------------------------------------ Spark ML heads
from ..operators import heads as H  # noqa: E402


def _ml_bench(kind: str) -> Query:
    def q(spark, sf_dir):
        return B.round_cols(B.benchmark(H.MLHeadMSP(kind=kind), FX.vector_splits(spark, sf_dir)))
    return q


for _kind in ("logreg", "random_forest", "linear_svc"):
    register(f"bench_ml_{_kind}_msp")(_ml_bench(_kind))


@register("hpo_logreg_cv")
def hpo_logreg_cv(spark, sf_dir):
    _, scores = H.random_search_cv(FX.vector_splits(spark, sf_dir).train)
    return spark.createDataFrame(scores, "reg_param double, mean_mcc double")  # one row per trial


# ------------------------------------------------------------ format round trips
from . import roundtrip as RT  # noqa: E402

_RT_SQL = O.with_(O.UTT) + """
SELECT split, intent, count(*) AS n FROM ut WHERE NOT (split = 'train' AND intent = 'oos') GROUP BY split, intent"""

register("intent_tsv_roundtrip", _RT_SQL)(RT.intent_tsv_roundtrip)
register("intent_csv_roundtrip", _RT_SQL)(RT.intent_csv_roundtrip)


def _results_sql() -> str:
    knn = O.with_(O.VEC, O.KNN_SC, O.bench_sql(False))
    adb = O.with_(O.VEC, O.HEAD, O.ADB, """
tst AS (SELECT y, pred = 'oos' AS is_ood_pred FROM apred WHERE split = 'test')""" + O.label_metrics_sql("tst"))
    rake = O.with_(O.UTT, O.rake_sql(), O.RAKE_PRED) + O.label_metrics_sql("rpred")
    null = "CAST(NULL AS DOUBLE)"
    return f"""
SELECT * FROM (
SELECT 'embeddings' AS dataset, 'KNN' AS detector, 'precomputed' AS feature_extractor, 'False' AS use_best_ckpt,
       'False' AS is_ood_label_in_train, 'oos' AS ood_label, CAST(NULL AS VARCHAR) AS adb_alpha,
       CAST(NULL AS VARCHAR) AS adb_step_size, fpr_95, fpr_90, aupr, auroc, f1, mcc FROM ({knn})
UNION ALL
SELECT 'embeddings', 'ADB', 'precomputed', 'False', 'False', 'oos', '0.75', '0.01', {null}, {null}, {null}, {null}, f1, mcc
FROM ({adb})
UNION ALL
SELECT 'documents', 'RAKE', 'None', 'False', 'False', 'oos', NULL, NULL, {null}, {null}, {null}, {null}, f1, mcc
FROM ({rake}))"""


register("results_roundtrip", _results_sql())(RT.results_roundtrip)


# ------------------------------------------------------------ documents.source as the class column
def _source_powerset_sql(ratio: float) -> str:
    return f"""
WITH c AS (SELECT source AS cls, count(*) AS n FROM documents GROUP BY source),
co AS (SELECT cls, n, row_number() OVER (ORDER BY cls) - 1 AS b FROM c),
tot AS (SELECT sum(n) AS total, count(*) AS k FROM c),
masks AS (SELECT UNNEST(range(0, (SELECT 1 << k FROM tot))) AS mask),
m AS (SELECT masks.mask, co.cls, co.n, (masks.mask >> co.b) & 1 AS bit FROM masks, co),
g AS (SELECT mask, sum(n * bit) AS n_rows FROM m GROUP BY mask)
SELECT CAST(count(*) AS BIGINT) AS n_subsets, CAST(min(mask) AS BIGINT) AS min_mask, CAST(max(mask) AS BIGINT) AS max_mask,
       CAST(sum(n_rows) AS BIGINT) AS total_rows FROM g, tot
WHERE n_rows >= (1.0::DOUBLE - 0.15::DOUBLE) * {ratio}::DOUBLE * total::DOUBLE
  AND n_rows <= (1.0::DOUBLE + 0.15::DOUBLE) * {ratio}::DOUBLE * total::DOUBLE"""


@register("open_set_splits_sources", _source_powerset_sql(0.25))
def open_set_splits_sources(spark, sf_dir):
    """All subsets of the 20 document sources within the 25 % +- 15 % band
    (2^20 candidates), summarised: count, mask range and total rows."""
    d = FX.read_table(spark, sf_dir, "documents").select(F.col("source").alias("intent"))
    s = P.open_set_splits(d, 0.25)
    return s.agg(F.count(F.lit(1)).alias("n_subsets"), F.min("mask").alias("min_mask"),
                 F.max("mask").alias("max_mask"), F.sum("n_rows").cast("long").alias("total_rows"))


@register("stratified_folds_sources", _folds_sql().replace(VEC_ALL, """
WITH e AS (SELECT doc_id AS id, source AS intent FROM documents)"""))
def stratified_folds_sources(spark, sf_dir):
    d = FX.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("intent"))
    return P.stratified_folds(d)


# ------------------------------------------------------------ short-text fixture (conversations)
CONV_UT = """
ut AS (SELECT conv_id * 2147483648 + turn AS id, text, CASE WHEN role = 'system' THEN 'oos' ELSE role END AS intent,
              CASE WHEN conv_id % 5 < 3 THEN 'train' WHEN conv_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
       FROM conversations)"""


def _conv_splits(spark, sf_dir):
    return FX._three(FX.short_text_table(spark, sf_dir), False)


@register("bench_rake_conversations", O.with_(CONV_UT, O.rake_sql(), O.RAKE_PRED) + O.label_metrics_sql("rpred"))
def bench_rake_conversations(spark, sf_dir):
    sp = _conv_splits(spark, sf_dir)
    pred = TO.RakeDetector().fit(sp.train).predict(sp.test)
    return B.round_cols(B.benchmark_labels(pred, sp.test))


def _lr_bench(splits_fn, noise: str = "uniform") -> Query:
    def q(spark, sf_dir):
        sp = splits_fn(spark, sf_dir)
        detector = LR.LikelihoodRatio(noise=noise, p_noise=LR_P_NOISE).fit(sp.train)
        scored = B.with_labels(detector.score(sp.test), sp.test).checkpoint()
        m = M.ranking_metrics(scored, interpolate=False)
        return B.round_cols(m.select(F.col("fpr_95").alias("fpr95"), F.col("fpr_90").alias("fpr90"), "aupr", "auroc"))
    return q


register("bench_likelihood_ratio_conversations", _lr_sql(utterances=CONV_UT))(_lr_bench(_conv_splits))


CROSS_UT = """
ut AS (SELECT 2 * doc_id AS id, text, lang AS intent,
              CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM documents
       UNION ALL
       SELECT 2 * item_id + 1 AS id, text, 'oos' AS intent, CASE WHEN item_id % 2 = 0 THEN 'val' ELSE 'test' END AS split
       FROM benchmark)"""

register("bench_likelihood_ratio_cross_corpus",
         _lr_sql(utterances=CROSS_UT))(
    _lr_bench(FX.cross_corpus_splits))


QUALITY_UT = """
ut AS (SELECT d.doc_id AS id, d.text, CASE WHEN l.quality = 0 THEN 'oos' ELSE 'ok' END AS intent,
              CASE WHEN d.doc_id % 5 < 3 THEN 'train' WHEN d.doc_id % 5 = 3 THEN 'val' ELSE 'test' END AS split
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

register("bench_likelihood_ratio_quality",
         _lr_sql(utterances=QUALITY_UT))(
    _lr_bench(FX.quality_splits))


@register("vocab_decode", O.with_(O.UTT, O.TOK, O.ENC, """
te AS (SELECT id, pos, token_id FROM enc WHERE split = 'test'),
lst AS (SELECT id, max(pos) AS L FROM te GROUP BY id),
seq AS (SELECT id, pos, token_id FROM te UNION ALL SELECT id, -1, 1 FROM lst
        UNION ALL SELECT id, L + 1, 2 FROM lst UNION ALL SELECT id, L + 2, 0 FROM lst),
words AS (SELECT idx AS token_id, word FROM vocab UNION ALL SELECT 0, '[PAD]' UNION ALL SELECT 1, '[BOS]'
          UNION ALL SELECT 2, '[EOS]' UNION ALL SELECT 3, '[UNK]' UNION ALL SELECT 4, '[SEP]'),
eo AS (SELECT id, min(pos) AS e FROM seq WHERE token_id = 2 GROUP BY id)""") + """
SELECT seq.id, string_agg(words.word, ' ' ORDER BY seq.pos) AS text
FROM seq JOIN words ON seq.token_id = words.token_id LEFT JOIN eo ON seq.id = eo.id
WHERE eo.e IS NULL OR seq.pos < eo.e GROUP BY seq.id""")
def vocab_decode(spark, sf_dir):
    sp = _utt(spark, sf_dir)
    tok = TXT.default_tokenizer(F.col("text"))
    vocab = TO.vocab_build(sp.train, tok).checkpoint()
    seq = TO.with_boundaries(TO.vocab_encode(sp.test, vocab, tok))
    return TO.decode_long(seq, vocab)


@register("pick_open_set_splits", "SELECT * FROM (" + _powerset_sql(0.25) + """)
ORDER BY md5(concat_ws('/', 0, mask)), mask LIMIT 5""")
def pick_open_set_splits(spark, sf_dir):
    e = FX.read_table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("intent"))
    return P.pick_splits(P.open_set_splits(e, 0.25), 5, seed=0)


def _cv_sql(k: int = 5) -> str:
    def upto(m, i):
        return f"(CASE WHEN {m} >= {i} THEN floor(({m} - {i}) / {k}) + 1 ELSE 0 END)"
    allocs = [f"({upto('s + n - 1', i)} - {upto('s - 1', i)})" for i in range(k)]
    cums = [" + ".join(allocs[: i + 1]) for i in range(k)]
    fold = " + ".join(f"(CASE WHEN {c} <= r THEN 1 ELSE 0 END)" for c in cums)
    return O.with_(O.VEC, f"""
fc AS (SELECT intent, count(*) AS n, min(id) AS first_id FROM tr GROUP BY intent),
fco AS (SELECT intent, n, coalesce(sum(n) OVER (ORDER BY first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM fc),
fr AS (SELECT tr.id, fco.n, fco.s, row_number() OVER (PARTITION BY tr.intent ORDER BY tr.id) - 1 AS r
       FROM tr JOIN fco USING (intent)),
folds AS (SELECT id, CAST({fold} AS INTEGER) AS fold FROM fr),
rows_ AS (SELECT tr.id, tr.v, tr.intent, folds.fold,
                 list_transform(tr.v, lambda x: x / sqrt(greatest(list_sum(list_transform(tr.v, lambda y: y * y)), 1e-12))) AS u
          FROM tr JOIN folds USING (id)),
fl AS (SELECT f.f, rows_.intent, UNNEST(rows_.u) AS x, UNNEST(generate_series(1, len(rows_.u))) AS pos
       FROM range({k}) f(f), rows_ WHERE rows_.fold <> f.f),
fa AS (SELECT f, intent, pos, avg(x) AS m FROM fl GROUP BY f, intent, pos),
fn AS (SELECT f, intent, pos, m / sqrt(greatest(sum(m * m) OVER (PARTITION BY f, intent), 1e-12)) AS c FROM fa),
fcent AS (SELECT f, intent AS cls, list(c ORDER BY pos) AS c FROM fn GROUP BY f, intent),
fz AS (SELECT rows_.fold AS f, rows_.id, rows_.intent, fcent.cls,
              list_inner_product(rows_.v, fcent.c) / sqrt(list_sum(list_transform(rows_.v, lambda y: y * y))) AS z
       FROM rows_ JOIN fcent ON fcent.f = rows_.fold),
fp AS (SELECT f, id, intent, cls AS pred FROM
       (SELECT *, row_number() OVER (PARTITION BY id ORDER BY z DESC, cls) AS rn FROM fz) WHERE rn = 1),
pc AS (SELECT f, intent AS t, pred AS q, count(*) AS c FROM fp GROUP BY ALL),
lbl AS (SELECT f, t AS label FROM pc UNION SELECT f, q FROM pc),
per AS (SELECT lbl.f, lbl.label,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.f = lbl.f AND t = lbl.label AND q = lbl.label), 0) AS DOUBLE) AS tp,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.f = lbl.f AND q = lbl.label), 0) AS DOUBLE) AS np,
          CAST(coalesce((SELECT sum(c) FROM pc WHERE pc.f = lbl.f AND t = lbl.label), 0) AS DOUBLE) AS sup FROM lbl),
pf AS (SELECT f, sum(tp) / sum(sup) AS accuracy,
              avg(CASE WHEN np + sup > 0 THEN 2.0 * tp / (np + sup) ELSE 0.0 END) AS f1_macro,
              sum(tp) AS cc, sum(sup) AS ss, sum(sup * np) AS tps, sum(np * np) AS pp, sum(sup * sup) AS tt FROM per GROUP BY f),
pm AS (SELECT f, accuracy, f1_macro,
              CASE WHEN (ss * ss - pp) * (ss * ss - tt) > 0 THEN (cc * ss - tps) / sqrt((ss * ss - pp) * (ss * ss - tt))
                   ELSE 0.0 END AS mcc FROM pf)""") + """
SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
       round(avg(f1_macro), 6) AS f1_macro_mean, round(stddev_pop(f1_macro), 6) AS f1_macro_std,
       round(avg(mcc), 6) AS mcc_mean, round(stddev_pop(mcc), 6) AS mcc_std FROM pm"""


ORACLES["cv_centroid_head"] = _cv_sql()


@register("knn_scores_blocked", ORACLES["knn_scores"])
def knn_scores_blocked(spark, sf_dir):
    """knn_scores through the large-training-side path: no broadcast, training
    rows hashed into 64 KB blocks, (query block x training block) cogroup cells,
    per-query partial minima merged by a groupBy."""
    from ..operators.pairs import NearestOp, pair_scan
    sp = FX.vector_splits(spark, sf_dir)
    nn = pair_scan(sp.val.unionByName(sp.test), sp.train, NearestOp(1, "l2"), broadcast_bytes=0, block_bytes=64 << 10)
    return B.round_cols(nn.select(F.col("qid").alias("id"), F.col("value").alias("score")))

ORACLES["bench_mc_dropout"] = O.with_(O.VEC, O.HEAD, O.MC_DROPOUT_SC, O.bench_sql(True))


# ------------------------------------------------------------ metrics at table scale (lineitem)
def _lineitem_scored(spark, sf_dir):
    li = FX.read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"))


_LI = """
ts AS (SELECT l_extendedprice * (1 - l_discount) AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""


@register("lineitem_ranking_metrics", O.with_(_LI, O.roc_sql()) + """,
f95 AS (SELECT ((0.95 - (tp - pos) / P) * (fp / N) + (tp / P - 0.95) * ((fp - neg) / N)) / (tp / P - (tp - pos) / P) AS v
        FROM cum, tot WHERE tp / P >= 0.95 ORDER BY s DESC LIMIT 1),
f90 AS (SELECT ((0.9 - (tp - pos) / P) * (fp / N) + (tp / P - 0.9) * ((fp - neg) / N)) / (tp / P - (tp - pos) / P) AS v
        FROM cum, tot WHERE tp / P >= 0.9 ORDER BY s DESC LIMIT 1)
SELECT round(f95.v, 6) AS fpr_95, round(f90.v, 6) AS fpr_90, round(rk.aupr, 6) AS aupr, round(rk.auroc, 6) AS auroc
FROM f95, f90, rk""")
def lineitem_ranking_metrics(spark, sf_dir):
    """ROC-based metrics over every lineitem row (~6M distinct scores at sf1):
    range-partitioned prefix sums, no single-partition window."""
    return B.round_cols(M.ranking_metrics(_lineitem_scored(spark, sf_dir)))


@register("lineitem_threshold_curve", O.with_("""
vs AS (SELECT l_extendedprice * (1 - l_discount) AS score, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)""",
    "bnd AS" + O.bench_sql(False).split("bnd AS", 1)[1].split("\nbest AS")[0].rstrip(",")) + """
SELECT CAST(cm.i AS INTEGER) AS i, round(cm.t, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(mc.mcc, 6) AS mcc
FROM cm JOIN mc ON cm.i = mc.i""")
def lineitem_threshold_curve(spark, sf_dir):
    c = M.threshold_curve(_lineitem_scored(spark, sf_dir), outdomain_is_lower=False)
    return B.round_cols(c.select("i", "threshold", "tp", "fp", "fn", "tn", "mcc"))


from . import named, trained  # noqa: E402,F401  register their queries here
