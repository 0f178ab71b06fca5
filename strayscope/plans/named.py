"""Queries over named datasets, drawn class splits and sparse text features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TXT
from ..operators import sparse as SP
from ..operators import splits as SS
from ..operators import text as TO
from ..session import scratch_dir
from ..sources import fixtures as FX
from ..sources import loaders as L
from ..sources import readers as R
from . import benchmark as B
from . import oracles as O
from . import sweep as SW
from .catalog import CONV_UT, ORACLES, register

# ------------------------------------------------------------ drawn class splits
RATIOS, DRAWS = (0.25, 0.75), 5


def _draws_sql(ratios: tuple[float, ...] = RATIOS, n: int = DRAWS, tries: int = 64) -> str:
    """Lists every subset, numbers those of a band by (rows, mask) and takes the drawn ranks."""
    bands = " UNION ALL ".join(f"SELECT {r}::DOUBLE AS ratio" for r in ratios)
    return f"""
WITH c AS (SELECT source AS cls, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS b FROM documents WHERE source IS NOT NULL GROUP BY source),
tot AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS k FROM c),
masks AS (SELECT UNNEST(range(0, (SELECT 1 << k FROM tot))) AS mask),
sums AS (SELECT mask, CAST(sum(n * ((mask >> b) & 1)) AS BIGINT) AS n_rows FROM masks, c GROUP BY mask),
bands AS ({bands}),
ranked AS (SELECT ratio, mask, n_rows, row_number() OVER (PARTITION BY ratio ORDER BY n_rows, mask) - 1 AS r, count(*) OVER (PARTITION BY ratio) AS n_subsets
           FROM sums, tot, bands WHERE n_rows >= (1.0::DOUBLE - 0.15::DOUBLE) * ratio * total AND n_rows <= (1.0::DOUBLE + 0.15::DOUBLE) * ratio * total),
sizes AS (SELECT DISTINCT ratio, n_subsets FROM ranked),
tries AS (SELECT j, list_transform(range(0, 64), lambda k: CAST('0x' || sha256('0/' || j)[k + 1] AS HUGEINT)) AS d FROM range(0, {tries}) t(j)),
picks AS (SELECT ratio, j, list_reduce(list_prepend(CAST(0 AS HUGEINT), d), lambda a, x: (a * 16 + x) % n_subsets) AS r FROM tries, sizes),
firsts AS (SELECT ratio, r, row_number() OVER (PARTITION BY ratio ORDER BY min(j)) - 1 AS draw FROM picks GROUP BY ratio, r),
got AS (SELECT ratio, draw, mask, n_rows, n_subsets FROM firsts JOIN ranked USING (ratio, r) WHERE draw < {n})
SELECT ratio, CAST(draw AS INTEGER) AS draw, CAST(any_value(n_subsets) AS VARCHAR) AS n_subsets, any_value(n_rows) AS n_rows,
       coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (WHERE (mask >> b) & 1 = 1), '') AS classes,
       coalesce(string_agg(cls, ',' ORDER BY cls) FILTER (WHERE (mask >> b) & 1 = 0), '') AS complement
FROM got, c GROUP BY ratio, draw"""


@register("draw_open_set_splits", _draws_sql())
def draw_open_set_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five class subsets for each ratio of in-domain rows, drawn without listing the subsets."""
    rows = FX.read_table(spark, sf_dir, "documents").select(F.col("source").alias("intent"))
    out = None
    for ratio in RATIOS:
        drawn = SS.draw_splits(rows, ratio, DRAWS)
        part = drawn.select(F.lit(ratio).alias("ratio"), "draw", "n_subsets", "n_rows", F.array_join("classes", ",").alias("classes"),
                            F.array_join("complement", ",").alias("complement"))
        out = part if out is None else out.unionByName(part)
    return out


_PART_DRAWS = _draws_sql().replace("source AS cls", "p_type AS cls").replace("ORDER BY source", "ORDER BY p_type").replace(
    "FROM documents WHERE source IS NOT NULL GROUP BY source", "FROM part WHERE p_partkey % 5 < 3 AND p_type IS NOT NULL GROUP BY p_type")


@register("split_tables_roundtrip", f"""
WITH drawn AS ({_PART_DRAWS}),
p AS (SELECT p_type, CASE WHEN p_partkey % 5 < 3 THEN 'train' WHEN p_partkey % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM part),
x AS (SELECT CAST(round(100 * ratio) AS INTEGER) AS k, draw AS version, split, p_type,
             CAST(NOT list_contains(string_split(classes, ','), p_type) AS INTEGER) AS ood FROM p, drawn)
SELECT k, version, split, CASE WHEN ood = 1 THEN 'oos' ELSE p_type END AS intent, ood, count(*) AS n
FROM x WHERE NOT (split = 'train' AND ood = 1) GROUP BY ALL""")
def split_tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws five in-domain class sets of the training rows for each ratio, writes the 30
    split tables (text, labels, is_ood), and reads each back through its named loader."""
    parts = FX.read_table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("labels"),
                                                        FX.split_of(F.col("p_partkey")).alias("split"))
    root, out = scratch_dir(spark, "split-tables"), None
    for ratio in RATIOS:
        k = round(100 * ratio)
        drawn = SS.draw_splits(parts.filter("split = 'train'"), ratio, DRAWS, label="labels")
        versions = [r["draw"] for r in drawn.select("draw").collect()]  # at most DRAWS
        R.write_splits(SS.split_versions(parts, drawn, "labels"), f"{root}/snips", k)
        for version in versions:
            loader = L.subset_loader(spark, f"snips_{k}", root, version=version)
            for subset in L.SUBSETS:
                part = loader(subset).groupBy("split", "intent", "ood").agg(F.count(F.lit(1)).alias("n"))
                part = part.select(F.lit(k).alias("k"), F.lit(version).alias("version"), "split", "intent", "ood", "n")
                out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ from a named dataset to a benchmark row

def write_layouts(rows: DataFrame, root: str) -> None:
    """``rows`` (text, intent, split) in the layouts of three named datasets: TSV, CSV with
    a flag, plain CSV.  White space inside a text becomes single spaces (one record a line)."""
    ood = F.col("intent") == FX.OOD_LABEL
    line = rows.select(F.regexp_replace("text", r"\s+", " ").alias("text"), "intent", "split", ood.alias("ood"))

    def files(condition, columns, path, **options):
        line.filter(condition).select(*columns).write.options(escape='"', **options).csv(path)

    tsv = [F.when(F.col("ood"), R.ROSTD_OOD).otherwise(F.col("intent")).alias("c0"), F.lit("-").alias("c1"), F.col("text").alias("c2"),
           F.when(F.col("ood"), R.ROSTD_FILLER).otherwise("-").alias("c3")]
    train = F.col("split") == "train"
    for name, condition in (("OODRemovedtrain", train & ~F.col("ood")), ("OODrelease", train & F.col("ood")),
                            ("eval", F.col("split") == "val"), ("test", F.col("split") == "test")):
        files(condition, tsv, f"{root}/rostd/{name}.tsv", sep="\t")
    flagged = ["text", F.when(F.col("ood"), "none").otherwise(F.col("intent")).alias("labels"), F.col("ood").cast("int").alias("is_ood")]
    for s in L.SUBSETS:
        files(F.col("split") == s, flagged, R.snips_path(f"{root}/snips", s), header=True)
        files(F.col("split") == s, ["text", "intent"], f"{root}/yellow/{s}.csv", header=True)


LAYOUTS = ("rostd", "snips", "yellow")


@register("benchmark_by_name", "SELECT name AS dataset, n_rows, n_rows AS n_ids, f1, mcc FROM (" + O.with_(CONV_UT, O.rake_sql(), O.RAKE_PRED)
          + O.label_metrics_sql("rpred") + ") AS m, (SELECT count(*) AS n_rows FROM conversations WHERE conv_id % 5 > 2 OR role <> 'system') AS sizes, "
          "(VALUES ('rostd'), ('snips'), ('yellow')) AS names(name)")
def benchmark_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, written in three layouts, loaded by dataset name
    and put to the keyword detector: rows, different ids, f1 and mcc of each dataset."""
    root, out = scratch_dir(spark, "layouts"), None
    write_layouts(FX.short_text_table(spark, sf_dir), root)
    for name in LAYOUTS:
        rows = L.load(spark, name, root)
        sp = L.as_splits(rows)
        result = B.benchmark_labels(TO.RakeDetector().fit(sp.train).predict(sp.test), sp.test)
        size = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_ids")).first()
        part = result.select(F.lit(name).alias("dataset"), F.lit(size["n_rows"]).alias("n_rows"), F.lit(size["n_ids"]).alias("n_ids"), "f1", "mcc")
        out = part if out is None else out.unionByName(part)
    return B.round_cols(out)


# ------------------------------------------------------------ bag of words and tf-idf as detector input

def sparse_sql(kind: str, cosine: bool) -> str:
    """sc(id, split, y, score) of ``ut``: all pairs of rows that share a term."""
    weight = "cnt.c * idf.idf" if kind == "tf_idf" else "CAST(cnt.c AS DOUBLE)"
    unit = cosine or kind == "tf_idf"
    score = ("round(greatest(coalesce(max(k.dot), 0), 0), 9)" if cosine else
             "sqrt(greatest(round(coalesce(any_value(n2), 0) + least(coalesce(min(k.far), any_value(least_n2)), any_value(least_n2)), 9), 0))")
    return f"""
sids AS (SELECT id, split, intent FROM ut WHERE split <> 'train' OR intent <> 'oos'),
sbw AS (SELECT id, split, UNNEST(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM ut WHERE split <> 'train' OR intent <> 'oos'),
cnt AS (SELECT id, split, token, count(*) AS c FROM sbw GROUP BY ALL),
idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM sids WHERE split = 'train')) / (1.0 + count(*))) + 1.0 AS idf
        FROM cnt WHERE split = 'train' GROUP BY token),
sw AS (SELECT id, split, token, {weight} AS w FROM cnt JOIN idf USING (token)),
sn AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM sw GROUP BY id),
sv AS (SELECT sw.id, split, token, {"w / nrm" if unit else "w"} AS w FROM sw JOIN sn USING (id)),
s2 AS (SELECT sids.id, sids.split, coalesce({"1.0" if unit else "nrm * nrm"}, 0) * CAST(nrm IS NOT NULL AS INTEGER) AS n2 FROM sids LEFT JOIN sn USING (id)),
fl AS (SELECT min(n2) AS least_n2 FROM s2 WHERE split = 'train'),
k0 AS (SELECT q.id, r.id AS rid, sum(q.w * r.w) AS dot FROM sv q JOIN sv r USING (token) WHERE q.split <> 'train' AND r.split = 'train' GROUP BY q.id, r.id),
k AS (SELECT k0.id, dot, s2.n2 - 2 * dot AS far FROM k0 JOIN s2 ON s2.id = k0.rid),
sc AS (SELECT sids.id, sids.split, CAST(any_value(intent) = 'oos' AS INTEGER) AS y, {score} AS score
       FROM sids JOIN s2 USING (id) LEFT JOIN k ON k.id = sids.id, fl WHERE sids.split <> 'train' GROUP BY sids.id, sids.split)"""


def _sparse_bench(detector: type[SP.SparseNN], kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sp = L.as_splits(FX.short_text_table(spark, sf_dir))
        train = sp.train.filter(F.col("intent") != FX.OOD_LABEL)
        return B.round_cols(B.benchmark(detector(kind), FX.Splits(train, sp.val, sp.test)))
    return query


for _name, _detector, _kind in (("bench_knn_tf_idf", SP.TextKNN, "tf_idf"), ("bench_cosine_nn_tf_idf", SP.TextCosineNN, "tf_idf"),
                                ("bench_knn_bow", SP.TextKNN, "bow")):
    register(_name, O.with_(CONV_UT, sparse_sql(_kind, _detector.cosine), O.bench_sql(_detector.outdomain_is_lower)))(_sparse_bench(_detector, _kind))


# ------------------------------------------------------------ sentiment rows against a foreign corpus
_SST_UT = """
ut AS (SELECT 2 * (conv_id * 2147483648 + turn) AS id, regexp_replace(text, '\\s+', ' ', 'g') AS text, CASE WHEN role = 'user' THEN 'positive' ELSE 'negative' END AS intent,
              CASE WHEN conv_id % 5 < 3 THEN 'train' WHEN conv_id % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM conversations
       UNION ALL SELECT 2 * item_id + 1, text, 'oos', CASE WHEN item_id % 2 = 0 THEN 'val' ELSE 'test' END FROM benchmark)"""


@register("bench_foreign_corpus", "SELECT kind AS ood_type, m.* FROM (" + O.with_(_SST_UT, sparse_sql("tf_idf", True), O.bench_sql(True))
          + ") AS m, (VALUES ('multi30k'), ('rte')) AS kinds(kind)")
def bench_foreign_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the sentiment corpus (user turns positive), benchmark items as the foreign
    one, in its one-column and in its two-sentence layout (cut after the first word), through
    the ``sst`` loader to the tf-idf cosine detector."""
    root = scratch_dir(spark, "sst")
    turns = FX.short_text_table(spark, sf_dir).select(F.regexp_replace("text", r"\s+", " ").alias("text"), "split",
                                                      (F.col("intent") == "user").cast("int").alias("label"))
    items = FX.read_table(spark, sf_dir, "benchmark").select(F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"),
                                                             F.when(F.pmod("item_id", F.lit(2)) == 0, "val").otherwise("test").alias("split"))
    for s in L.SUBSETS:
        turns.filter(F.col("split") == s).select("text", "label").write.options(sep="\t", escape='"').csv(f"{root}/sst/{s}.tsv")
    for s in ("val", "test"):
        mine = items.filter(F.col("split") == s)
        mine.select("text").write.text(f"{root}/sst/{L.FOREIGN_FILES['multi30k'][s]}")
        pair = [F.substring_index("text", " ", 1).alias("sentence1"), F.regexp_replace("text", "^[^ ]* ?", "").alias("sentence2")]
        mine.select(*pair).write.options(sep="\t", escape='"', header=True).csv(f"{root}/sst/{L.FOREIGN_FILES['rte'][s]}")
    out = None
    for kind in ("multi30k", "rte"):
        loader = L.subset_loader(spark, "sst", root, ood_type=kind)
        splits = FX.Splits(*[loader(s) for s in L.SUBSETS])
        part = B.benchmark(SP.TextCosineNN(), splits).withColumn("ood_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return B.round_cols(out)


# ------------------------------------------------------------ text detectors of the grid

def _text_grid_sql() -> str:
    none = "CAST(NULL AS DOUBLE) AS {}"
    parts = []
    for detector, query, own in (("rake", "bench_rake_conversations", ("f1", "mcc")),
                                 ("likelihood_ratio", "bench_likelihood_ratio_conversations", ("fpr95", "fpr90", "aupr", "auroc")),
                                 ("text_cosine_nn", "bench_cosine_nn_tf_idf", SW.METRICS), ("text_knn", "bench_knn_tf_idf", SW.METRICS)):
        columns = ", ".join(c if c in own else none.format(c) for c in SW.TEXT_COLUMNS)
        parts.append(f"SELECT 'conversations' AS dataset, '{detector}' AS detector, false AS is_ood_label_in_train, {columns} FROM ({ORACLES[query]})")
    return " UNION ALL ".join(parts)


@register("sweep_text_grid", _text_grid_sql())
def sweep_text_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, likelihood-ratio and tf-idf detectors over the conversations; the rows with the OOD
    class in training are left out, as each of them refuses it."""
    def splits_of(ood_in_train: bool) -> FX.Splits:
        sp = L.as_splits(FX.short_text_table(spark, sf_dir))
        return sp if ood_in_train else FX.Splits(sp.train.filter(F.col("intent") != FX.OOD_LABEL), sp.val, sp.test)
    return SW.run_text_sweep(splits_of)


# ------------------------------------------------------------ enhanced keywords from given word vectors
GIVEN_DIM = 8
_GIVEN_SQL = O.with_(CONV_UT, O.rake_sql()) + """,
gw AS (SELECT DISTINCT UNNEST(toks) AS word FROM rt2 WHERE split = 'train' AND intent <> 'oos'),
gv AS (SELECT word, list_transform(range(0, 8), lambda j:
          sqrt(-2.0 * ln(((('0x' || substr(md5(concat_ws('/', 0, word, j, 'a')), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))
          * cos(2.0 * 3.141592653589793 * ((('0x' || substr(md5(concat_ws('/', 0, word, j, 'b')), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE)
          * 0.3836) AS vec FROM gw),
gp AS (SELECT phrase, UNNEST(string_split(phrase, ' ')) AS word FROM ph),
gl AS (SELECT phrase, UNNEST(vec) AS x, UNNEST(generate_series(1, 8)) AS j FROM gp JOIN gv USING (word)),
gm AS (SELECT phrase, list(m ORDER BY j) AS v FROM (SELECT phrase, j, avg(x) AS m FROM gl GROUP BY phrase, j) GROUP BY phrase),
gs AS (SELECT phrase, word, list_cosine_similarity(v, vec) AS s FROM gm, gv WHERE phrase <> word),
gt AS (SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY phrase ORDER BY s DESC, word) AS r FROM gs) WHERE r <= 5)
SELECT phrase, len(string_split(phrase, ' ')) AS n_words FROM (SELECT phrase FROM kw UNION SELECT word FROM gt)
WHERE phrase NOT IN ('want', 'my', 'send', 'much', 'please', 'plz', 'need', 'know', 'name', 'tell', 'help', 'ok', 'okay', 'is', 'was', 'wa', 'I', 'am', 'were', 'are', 'will', 'should')"""


@register("enhanced_keywords_given_vectors", _GIVEN_SQL)
def enhanced_keywords_given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enhanced keyword set of the conversations, similar terms by given word vectors."""
    sp = L.as_splits(FX.short_text_table(spark, sf_dir))
    train = sp.train.filter(F.col("intent") != FX.OOD_LABEL)
    vocab = TO.vocab_build(train, TXT.rake_tokens(F.col("text"))).checkpoint()
    vectors = TO.word_vector_table(vocab, dim=GIVEN_DIM).join(vocab, "idx").select("word", "vec").checkpoint()
    kw = TO.rake_keywords_enhanced(train, lambda phrases: TO.similar_terms(TO.mean_of_words(phrases, vectors), vectors))
    return kw.select("phrase", F.col("n_words").cast("long").alias("n_words"))
