"""Text operators: RAKE keywords + keyword containment (the keyword
detector), vocabulary build/encode/decode, bag of words and tf-idf, word vectors.

Utterance frames carry ``id`` and ``text``.  Everything is a DataFrame plan;
small dimension tables (keywords, vocabulary, idf) are broadcast only after a
row-count check, otherwise they are shuffle-joined (AQE splits skewed keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written

SPECIALS = ("[PAD]", "[BOS]", "[EOS]", "[UNK]", "[SEP]")
PAD_ID, BOS_ID, EOS_ID, UNK_ID, SEP_ID = 0, 1, 2, 3, 4


def join_dimension(left: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a dimension table (vocabulary, keywords, class table).

    No static broadcast hint: the session disables estimate-based broadcasts
    and lets AQE turn the join into a broadcast only after the dimension side
    has been materialised and measured under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; larger dimensions stay
    shuffle joins with AQE skew splitting."""
    return left.join(dim, on, how)


# ------------------------------------------------------------------ RAKE

def rake_keywords(train: DataFrame, text_col: str = "text", stopwords=T.RAKE_STOPWORDS,
                  keyword_stopwords=T.KEYWORD_STOPWORDS) -> DataFrame:
    """Distinct RAKE phrases of the cleaned training utterances, minus one-word
    phrases that occur in no multi-word phrase, minus the custom stop-list.
    Returns (phrase, n_words)."""
    toks = train.select(T.rake_tokens(F.col(text_col)).alias("toks"))
    phrases = toks.select(F.explode(T.rake_phrases(F.col("toks"), stopwords)).alias("phrase")).distinct()
    phrases = phrases.withColumn("n_words", F.size(F.split("phrase", " "))).cache()
    multi_words = (phrases.filter(F.col("n_words") > 1)
                   .select(F.explode(F.split("phrase", " ")).alias("phrase")).distinct())
    singles = phrases.filter(F.col("n_words") == 1).join(multi_words, "phrase", "left_semi")
    kept = phrases.filter(F.col("n_words") > 1).unionByName(singles)
    return kept.filter(~F.col("phrase").isin(*keyword_stopwords))


def _gram_at(tokens: Column, n: int):
    # one-argument lambda: transform() passes (element, index) to two-argument ones
    return lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")


def token_ngrams(tokens: Column, lengths: list[int]) -> Column:
    """All contiguous token n-grams (joined by spaces) for n in ``lengths``."""
    parts = []
    for n in lengths:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        parts.append(F.transform(starts, _gram_at(tokens, n)))
    return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")


def keyword_hits(df: DataFrame, keywords: DataFrame, text_col: str = "text") -> DataFrame:
    """ids of utterances whose cleaned token sequence contains a keyword
    (whole-token, contiguous match).

    One-word keywords meet the tokens.  Candidates for longer ones are anchored on
    their first two words: a pair of tokens only spawns the n-grams of the lengths that
    keywords starting with it actually have, so few places spawn any.  Places, not
    token arrays, go through the join; they meet their tokens again by id."""
    words = F.split("phrase", " ")
    toks = df.select("id", T.rake_tokens(F.col(text_col)).alias("toks"))
    singles = keywords.filter("n_words = 1").select(F.col("phrase").alias("tok"))
    one = join_dimension(toks.select("id", F.explode(F.array_distinct("toks")).alias("tok")), singles, "tok", "left_semi").select("id")
    firsts = keywords.filter("n_words > 1").select(words[0].alias("tok"), words[1].alias("nxt"), "n_words").distinct()
    pairs = F.arrays_zip(F.slice("toks", 1, F.size("toks") - 1).alias("a"), F.slice("toks", 2, F.size("toks")).alias("b"))
    pos = (toks.filter(F.size("toks") > 1).select("id", F.size("toks").alias("size"), F.posexplode(pairs).alias("pos", "p"))
           .select("id", "size", "pos", F.col("p.a").alias("tok"), F.col("p.b").alias("nxt")))
    cand = join_dimension(pos, firsts, ["tok", "nxt"]).filter(F.col("pos") + F.col("n_words") <= F.col("size"))
    spans = cand.groupBy("id").agg(F.collect_set(F.struct("pos", "n_words")).alias("spans"))  # of one text
    grams = spans.join(toks, "id").select("id", F.explode(F.transform(
        "spans", lambda s: F.array_join(F.slice("toks", s["pos"] + 1, s["n_words"]), " "))).alias("phrase"))
    more = join_dimension(grams, keywords.filter("n_words > 1").select("phrase"), "phrase", "left_semi").select("id")
    return one.unionByName(more).distinct()


class RakeDetector:
    """Keyword detector: ``fit`` extracts and materialises the keyword table
    (checkpointed fitted state); ``predict`` flags rows containing no keyword."""

    name = "rake"

    def __init__(self, ood_label: str = "oos", text_col: str = "text"):
        self.ood_label, self.text_col = ood_label, text_col

    def fit(self, train: DataFrame) -> "RakeDetector":
        if train.filter(F.col("intent") == self.ood_label).limit(1).count() > 0:
            from .detectors import NotApplicable
            raise NotApplicable(f"found {self.ood_label!r} in training data; rake needs in-domain rows only")
        self.keywords = rake_keywords(train, self.text_col).checkpoint()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return rake_predict(df, self.keywords, self.text_col)


def rake_predict(df: DataFrame, keywords: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, is_ood_pred): out-of-domain iff no keyword occurs."""
    hits = keyword_hits(df, keywords, text_col).withColumn("hit", F.lit(True))
    return (df.select("id").join(hits, "id", "left")
            .select("id", F.col("hit").isNull().alias("is_ood_pred")))


# ------------------------------------------------------------ vocabulary

def vocab_build(train: DataFrame, tokens: Column, max_tokens: int | None = None) -> DataFrame:
    """(word, idx, cnt): counts ordered by (-count, word), ids from 5 after
    the five special tokens; optionally the ``max_tokens`` most frequent."""
    from .metrics import global_row_number
    counts = train.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = global_row_number(counts, [F.col("cnt").desc(), F.col("word").asc()], "rn")
    ranked = ranked.withColumn("idx", (F.col("rn") + 4).cast("int"))
    if max_tokens:
        ranked = ranked.filter(F.col("idx") < 5 + max_tokens)
    return ranked.select("word", "idx", "cnt")


def vocab_encode(df: DataFrame, vocab: DataFrame, tokens: Column) -> DataFrame:
    """Long form (id, pos, token_id): unknown words -> 3 (UNK)."""
    long = df.select("id", F.posexplode(tokens).alias("pos", "word"))
    j = join_dimension(long, vocab.select("word", "idx"), "word", "left")
    return j.select("id", F.col("pos").cast("int").alias("pos"), F.coalesce("idx", F.lit(UNK_ID)).alias("token_id"))


def encoded_arrays(encoded: DataFrame) -> DataFrame:
    """(id, ids array ordered by pos) from the long form (bounded per utterance)."""
    return encoded.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("_a")) \
        .select("id", F.transform("_a", lambda s: s["token_id"]).alias("ids"))


def pad_sequences(ids: Column, length: Column | int) -> Column:
    """[BOS] + ids + [EOS] padded with PAD to ``length``."""
    seq = F.concat(F.array(F.lit(BOS_ID)), ids, F.array(F.lit(EOS_ID)))
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(seq, F.array_repeat(F.lit(PAD_ID), F.greatest(length - F.size(seq), F.lit(0))))


def attention_mask(seq: Column) -> Column:
    return F.transform(seq, lambda x: F.when(x == PAD_ID, 0).otherwise(1))


def vocab_decode(ids: Column, id_to_word: Column) -> Column:
    """ids -> words up to the first EOS, joined by spaces (``id_to_word`` is a map column)."""
    pos = F.array_position(ids, EOS_ID)
    upto = F.when(pos > 0, F.slice(ids, 1, (pos - 1).cast("int"))).otherwise(ids)
    return F.array_join(F.transform(upto, lambda i: F.element_at(id_to_word, i)), " ")


def special_tokens(spark) -> DataFrame:
    return spark.createDataFrame([(i, w) for i, w in enumerate(SPECIALS)], "token_id int, word string")


def decode_long(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """Long-form sequences (id, pos, token_id) -> (id, text): words of the
    positions before the first EOS, in position order, joined by spaces
    (special ids decode to their names).  Per-sequence lists only."""
    words = vocab.select(F.col("idx").alias("token_id"), "word").unionByName(special_tokens(encoded.sparkSession))
    j = join_dimension(encoded, words, "token_id", "left")
    eos = encoded.filter(F.col("token_id") == EOS_ID).groupBy("id").agg(F.min("pos").alias("_eos"))
    j = j.join(eos, "id", "left").filter(F.col("_eos").isNull() | (F.col("pos") < F.col("_eos")))
    per = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
    return per.select("id", F.array_join(F.transform("_w", lambda x: x["word"]), " ").alias("text"))


def with_boundaries(encoded: DataFrame, n_pad: int = 1) -> DataFrame:
    """[BOS] + ids + [EOS] + PAD*n_pad in long form (positions -1 .. L + n_pad)."""
    last = encoded.groupBy("id").agg(F.max("pos").alias("L"))
    parts = [encoded.select("id", "pos", "token_id"),
             last.select("id", F.lit(-1).alias("pos"), F.lit(BOS_ID).alias("token_id")),
             last.select("id", (F.col("L") + 1).cast("int").alias("pos"), F.lit(EOS_ID).alias("token_id"))]
    for k in range(n_pad):
        parts.append(last.select("id", (F.col("L") + 2 + k).cast("int").alias("pos"), F.lit(PAD_ID).alias("token_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ bag of words / tf-idf

def bag_of_words(df: DataFrame, vocab_words: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """Long form (id, token, cnt): lower-cased words of >= 2 word characters,
    restricted to ``vocab_words`` (word) when given."""
    toks = df.select("id", F.explode(bow_tokens(text_col)).alias("token"))
    counts = toks.groupBy("id", "token").agg(F.count(F.lit(1)).alias("cnt"))
    if vocab_words is not None:  # after counting: a frequent word meets the vocabulary once a text, not once a place
        counts = join_dimension(counts, vocab_words.select(F.col("word").alias("token")), "token", "left_semi").select("id", "token", "cnt")
    return counts


def bow_tokens(text_col: str = "text") -> Column:
    return T.word_tokens(F.lower(F.col(text_col)), T.BOW_TOKEN_PATTERN)


def bow_vocabulary(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the different words of the bag of words of ``train``."""
    return train.select(F.explode(F.array_distinct(bow_tokens(text_col))).alias("word")).distinct()


def tfidf_fit(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, idf) with smooth idf = ln((1 + n) / (1 + df)) + 1 over training documents."""
    n = train.count()
    bow = bag_of_words(train, None, text_col)
    df_ = bow.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df_.select("token", (F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_transform(df: DataFrame, idf: DataFrame, text_col: str = "text") -> DataFrame:
    """Long form (id, token, weight): raw count x idf, then L2-normalised per row."""
    bow = bag_of_words(df, None, text_col)
    w = join_dimension(bow, idf, "token").select("id", "token", (F.col("cnt") * F.col("idf")).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"))
    return w.join(norm, "id").select("id", "token", (F.col("w") / F.col("nrm")).alias("weight"))


# ------------------------------------------------------------ hashed draws

def md5_uniform(*parts: Column) -> Column:
    """Deterministic uniform in [0, 1) from md5 of the '/'-joined parts."""
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)



# ------------------------------------------------------------ word vectors / pooling
WORD_VECTOR_SIGMA = 0.3836


def _md5_open_uniform(*parts: Column) -> Column:
    """Uniform in (0, 1) from md5 (never 0, so log is finite)."""
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / F.lit(4294967296.0)


def word_vector_table(vocab: DataFrame, vectors: DataFrame | None = None, dim: int = 16,
                      sigma: float = WORD_VECTOR_SIGMA, seed: int = 0) -> DataFrame:
    """(idx, vec) for the special tokens and every vocabulary word: the given
    pre-trained vector when the word has one (``vectors``: word, vec), else a
    deterministic N(0, sigma^2) draw per component (Box-Muller on md5 of
    (seed, word, component)); the padding id 0 maps to zeros."""
    spark = vocab.sparkSession
    specials = spark.createDataFrame([(w, i) for i, w in enumerate(SPECIALS) if i != PAD_ID], "word string, idx int")
    words = vocab.select("word", "idx").unionByName(specials)
    if vectors is not None:
        words = join_dimension(words, vectors.select("word", F.col("vec").alias("given")), "word", "left")
    else:
        words = words.withColumn("given", F.lit(None).cast("array<double>"))

    def comp(j):
        u1 = _md5_open_uniform(F.lit(seed), F.col("word"), j, F.lit("a"))
        u2 = _md5_open_uniform(F.lit(seed), F.col("word"), j, F.lit("b"))
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2) * F.lit(sigma)

    rnd = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), comp)
    pad = spark.createDataFrame([(PAD_ID, [0.0] * dim)], "idx int, vec array<double>")
    return words.select("idx", F.coalesce("given", rnd).alias("vec")).unionByName(pad)


def mean_pool(encoded: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """(id, v): masked mean of the token vectors of each sentence (padding
    excluded; sentences without tokens get no row)."""
    j = join_dimension(encoded.filter(F.col("token_id") != PAD_ID), word_vectors.withColumnRenamed("idx", "token_id"),
                       "token_id")
    per = j.groupBy("id").agg(F.collect_list("vec").alias("vs"))  # one sentence's tokens
    dim = F.size(F.element_at("vs", 1))
    zero = F.transform(F.sequence(F.lit(1), dim), lambda _: F.lit(0.0))
    total = F.aggregate("vs", zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return per.select("id", F.transform(total, lambda x: x / F.size("vs")).alias("v"))


def text_embeddings(df: DataFrame, train: DataFrame, dim: int = 16, seed: int = 0,
                    vectors: DataFrame | None = None) -> DataFrame:
    """Bag-of-word-vectors encoder: vocabulary from ``train``, vectors from
    ``vectors`` or the deterministic random fill, masked mean pooling."""
    tok = T.default_tokenizer(F.col("text"))
    vocab = vocab_build(train, tok).checkpoint()
    wv = word_vector_table(vocab, vectors, dim, seed=seed).checkpoint()
    return mean_pool(vocab_encode(df, vocab, tok), wv)


# ------------------------------------------------------------ similar terms (enhanced keywords)

def mean_of_words(phrases: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """(phrase, v): mean of the vectors (word, vec) of the phrase's words."""
    words = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("p", "word"))
    dim = word_vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    pv = join_dimension(words, word_vectors, "word").filter(F.size("vec") > 0)
    # one row for each phrase with a sum for each component, not a row for each component
    means = pv.groupBy("phrase").agg(*[F.avg(F.get("vec", F.lit(j))).alias(f"x{j}") for j in range(max(dim, 0))], F.max(F.size("vec")).alias("_n"))
    return means.select("phrase", F.slice(F.array(*[f"x{j}" for j in range(max(dim, 0))]).cast("array<double>"), 1, F.col("_n")).alias("v"))


def similar_terms(phrase_vectors: DataFrame, word_vectors: DataFrame, topn: int = 5) -> DataFrame:
    """(phrase, rank, term): the ``topn`` words (word, vec) most cosine-similar to each
    phrase (phrase, v), other than the phrase itself; exact top-k through the pair engine."""
    from .pairs import NearestOp, pair_scan
    # the vectors are long sums over words and n-grams: the engine's count, its scan and the join back read them written
    q = written(phrase_vectors.select(F.xxhash64("phrase").alias("id"), "phrase", "v"), "phrase-vectors")
    refs = written(word_vectors.select(F.xxhash64("word").alias("id"), F.col("vec").alias("v"), "word"), "term-vectors")
    nn = pair_scan(q, refs, NearestOp(topn + 1, "cosine_sim"), label_col="word")
    # one row for each phrase: its few nearest terms travel once, and no window sorts them
    best = nn.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("far"), F.col("ref_label").alias("term")))).alias("near"))
    best = best.join(q.select(F.col("id").alias("qid"), "phrase"), "qid")
    near = F.slice(F.filter("near", lambda t: t["term"] != F.col("phrase")), 1, topn)
    return best.select("phrase", F.posexplode(near).alias("at", "t")).select("phrase", (F.col("at") + 1).alias("rank"), F.col("t.term").alias("term"))


def all_phrases(train: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct RAKE phrases, unfiltered."""
    toks = train.select(T.rake_tokens(F.col(text_col)).alias("toks"))
    return toks.select(F.explode(T.rake_phrases(F.col("toks"))).alias("phrase")).distinct()


def rake_keywords_enhanced(train: DataFrame, terms_of, text_col: str = "text", keyword_stopwords=T.KEYWORD_STOPWORDS) -> DataFrame:
    """Enhanced keyword set: the keywords (one-word phrases that are in no longer one left
    out) and the similar terms of all phrases, minus the custom stop-list.
    ``terms_of`` maps the phrases to (phrase, rank, term)."""
    phrases = all_phrases(train, text_col).checkpoint()
    similar = terms_of(phrases).select(F.col("term").alias("phrase"))
    kept = rake_keywords(train, text_col, keyword_stopwords=keyword_stopwords).select("phrase")
    kw = kept.unionByName(similar).distinct().filter(~F.col("phrase").isin(*keyword_stopwords))
    return kw.withColumn("n_words", F.size(F.split("phrase", " ")))
