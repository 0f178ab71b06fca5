"""N-gram likelihood-ratio scores: add-k bigram models of the training texts and of
their noised copy (the background).

Noise replaces a word with probability ``p_noise`` by a vocabulary word drawn by one of
three distributions: ``uniform``, ``unigram`` (by count) or ``uniroot`` (by the square root of
the count).  The beginning and end marks are never replaced.  All draws are hashes of
(row id, place), so every evaluation draws the same.

Plan: the noised corpus is never built.  Its bigrams differ from the training ones only
where one of the two words was replaced, so these rows alone look up their new words
and enter one grouped sum as -1 for the old bigram and +1 for the new one, beside the +1 of
every training bigram.  Words are the keys: an unknown word has no counts, which is what the
unknown mark has.  Scored texts meet two tables, bigrams and contexts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import text as TO

NOISE_TYPES = ("uniform", "unigram", "uniroot")
ROOT_SCALE = 1 << 20  # weights are whole numbers: floor(2^20 * sqrt(count))
BOS, EOS = "\u0002[BOS]", "\u0002[EOS]"
SCORE_DIGITS = 9
FIXED = 1e12  # log ratios are added up as whole multiples of 1e-12, in any order


def weight(cnt: Column, noise: str) -> Column:
    if noise not in NOISE_TYPES:
        raise ValueError(f"unknown noise {noise!r}; known: {NOISE_TYPES}")
    return {"uniform": F.lit(1).cast("long"), "unigram": cnt.cast("long"),
            "uniroot": F.floor(F.sqrt(cnt) * float(ROOT_SCALE)).cast("long")}[noise]


def word_blocks(vocab: DataFrame, noise: str) -> tuple[DataFrame, int]:
    """(first, weight, start, stop) per distinct word weight, and the total weight.

    Vocabulary ids follow the counts, so words of one count have consecutive ids; with c_1 >
    c_2 > ... their weights take up [start, stop) of the total.  There are at most
    sqrt(2 * words of text) distinct counts, which one window runs over."""
    per = vocab.groupBy("cnt").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    per = per.select("first", "n", weight(F.col("cnt"), noise).alias("weight"))
    upto = F.sum(F.col("n") * F.col("weight")).over(Window.orderBy("first"))
    blocks = per.select("first", "weight", (upto - F.col("n") * F.col("weight")).alias("start"), upto.alias("stop")).checkpoint()
    return blocks, int(blocks.agg(F.max("stop")).first()[0] or 0)


def drawn_words(draws: DataFrame, vocab: DataFrame, noise: str) -> DataFrame:
    """``draws`` (u in [0, 1), ...) with ``word``: the one whose share of the total weight
    holds u.

    A range join on the cumulative weights by buckets: each block of equal words is listed
    in the buckets that it touches (twice as many rows as blocks and buckets at most), a draw
    looks into its own bucket, and the block's arithmetic gives the word's id."""
    blocks, total = word_blocks(vocab, noise)
    n = 4 * blocks.count() + 1
    width = total // n + 1
    at = F.floor(F.col("u") * float(total)).cast("long")
    wide = F.call_function("div", F.col("stop") - 1, F.lit(width).cast("long"))
    listed = blocks.withColumn("_bucket", F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(width).cast("long")), wide)))
    asked = draws.withColumn("_at", at).withColumn("_bucket", F.call_function("div", F.col("_at"), F.lit(width).cast("long")))
    # at most four buckets for each distinct count, and so many blocks: a few columns of numbers, sent to every task
    found = asked.join(F.broadcast(listed), "_bucket").filter((F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("stop")))
    found = found.withColumn("idx", (F.col("first") + F.call_function("div", F.col("_at") - F.col("start"), F.col("weight"))).cast("int"))
    return TO.join_dimension(found, vocab.select("idx", "word"), "idx").select(*draws.columns, "word")


def _uniform(digits: int, *parts: Column) -> Column:
    """Number in [0, 1) of the first ``digits`` hexadecimal digits of an md5."""
    h = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long") / F.lit(float(16 ** digits))


def _replaced(toks: Column, p_noise: float, seed: int) -> Column:
    """For each word whether noise replaces it: the first eight hexadecimal digits of its md5
    are under ``p_noise`` of 16^8, which their order as text tells (one md5 a word, no number)."""
    limit = math.ceil(min(max(p_noise, 0.0), 1.0) * 16 ** 8)
    if limit >= 16 ** 8:
        return F.transform(toks, lambda w: F.lit(True))

    def hit(_, place: Column) -> Column:
        return F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"), place.cast("string"), F.lit("noise"))), 1, 8) < f"{limit:08x}"
    return F.transform(toks, hit)


def bigrams(rows: DataFrame, tokens: str = "toks", hits: str | None = None) -> DataFrame:
    """(id, pos, prev, tok) of [BOS] + words + [EOS]; ``pos`` is the place of ``tok``.  Rows
    without words have none.  ``hits``, a flag for each word, adds (ph, th) of prev and tok."""
    t = rows.filter(F.size(tokens) > 0)

    def sides(words: Column, first: Column, last: Column, names: tuple[str, str]) -> list[Column]:
        return [F.concat(F.array(first), words).alias(names[0]), F.concat(words, F.array(last)).alias(names[1])]

    arrays = sides(F.col(tokens), F.lit(BOS), F.lit(EOS), ("prev", "tok"))
    if hits:
        arrays += sides(F.col(hits), F.lit(False), F.lit(False), ("ph", "th"))
    pairs = t.select("id", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    return pairs.select("id", F.col("pos").cast("int").alias("pos"), "z.*")


def bigram_counts(train: DataFrame, vocab: DataFrame, noise: str = "uniform", p_noise: float = 0.1, seed: int = 0,
                  asked: DataFrame | None = None) -> DataFrame:
    """(prev, tok, n_in, n_bg): bigrams of the training texts and of their noised copy.  With
    ``asked`` (prev, tok) rows those bigrams are listed too, unseen ones with no counts, and ``asked`` flags them: they
    meet their counts in the same exchange."""
    seen = bigrams(train)
    digits = 8 if noise == "uniform" else 13

    def drawn(hit: str, place: Column) -> Column:
        return F.when(F.col(hit), _uniform(digits, F.lit(seed), F.col("id"), place, F.lit("word")))

    noised = bigrams(train.withColumn("_hits", _replaced(F.col("toks"), p_noise, seed)), hits="_hits").filter("ph OR th")
    ids = train.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d")).first()
    if ids["n"] != ids["d"]:  # a place of a repeated row changes once
        noised = noised.dropDuplicates(["id", "pos", "prev", "tok"])
    noised = noised.select("prev", "tok", drawn("ph", F.col("pos") - 1).alias("pu"), drawn("th", F.col("pos")).alias("tu"))
    # the place of a row isn't needed any more: one side is looked up after the other
    first = drawn_words(noised.filter("pu IS NOT NULL").select(F.col("pu").alias("u"), "tok", "tu"), vocab, noise)
    first = first.select(F.col("word").alias("prev"), "tok", "tu").unionByName(noised.filter("pu IS NULL").select("prev", "tok", "tu"))
    second = drawn_words(first.filter("tu IS NOT NULL").select(F.col("tu").alias("u"), "prev"), vocab, noise).select("prev", F.col("word").alias("tok"))
    new = second.unionByName(first.filter("tu IS NULL").select("prev", "tok"))

    def counted(rows: DataFrame, n_in: int, n_bg: int, mark: bool = False) -> DataFrame:
        return rows.select("prev", "tok", F.lit(n_in).alias("n_in"), F.lit(n_bg).alias("n_bg"), F.lit(mark).alias("asked"))

    rows = counted(seen, 1, 1).unionByName(counted(noised, 0, -1)).unionByName(counted(new, 0, 1))
    if asked is None:
        return rows.groupBy("prev", "tok").agg(F.sum("n_in").alias("n_in"), F.sum("n_bg").alias("n_bg"))
    rows = rows.unionByName(counted(asked, 0, 0, True))
    return rows.groupBy("prev", "tok").agg(F.sum("n_in").alias("n_in"), F.sum("n_bg").alias("n_bg"), F.max("asked").alias("asked"))


def likelihood_ratio_scores(train: DataFrame, rows: DataFrame, vocab: DataFrame, noise: str = "uniform", p_noise: float = 0.1,
                            k: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, score) of ``rows`` (id, toks): minus the sum over words of log p_train - log p_background.

    ``vocab`` is that of all words of ``train`` (id, toks).  High = out-of-domain.  Log ratios are
    added as whole multiples of 1e-12 and the score has nine digits, so texts with the same
    bigrams tie exactly."""
    # each different bigram meets its counts once, however often it stands in the rows
    asked = bigrams(rows)
    counts = written(bigram_counts(train, vocab, noise, p_noise, seed, asked), "bigram-counts")
    contexts = counts.groupBy("prev").agg(F.sum("n_in").alias("x_in"), F.sum("n_bg").alias("x_bg"))
    smooth = F.lit(k * (vocab.count() + len(TO.SPECIALS)))
    met = TO.join_dimension(counts.filter("asked"), contexts, "prev", "left")

    def logp(pair: str, context: str) -> Column:
        return F.log((F.coalesce(pair, F.lit(0)) + F.lit(k)) / (F.coalesce(context, F.lit(0)) + smooth))

    ratio = F.round((logp("n_in", "x_in") - logp("n_bg", "x_bg")) * FIXED).cast("decimal(20,0)")
    ratios = met.select("prev", "tok", ratio.alias("ratio"))
    total = TO.join_dimension(asked, ratios, ["prev", "tok"]).groupBy("id").agg(F.sum("ratio").cast("double").alias("_s"))
    return total.select("id", F.round(-(F.col("_s") / FIXED), SCORE_DIGITS).alias("score"))


class LikelihoodRatio:
    """Likelihood-ratio detector: ``fit`` takes the training texts (id, text, intent)."""

    name = "likelihood_ratio"
    outdomain_is_lower = False

    def __init__(self, ood_label: str = "oos", noise: str = "uniform", p_noise: float = 0.1, text_col: str = "text", seed: int = 0):
        weight(F.lit(1), noise)
        self.ood_label, self.noise, self.p_noise, self.text_col, self.seed = ood_label, noise, p_noise, text_col, seed

    def _tokens(self, df: DataFrame) -> DataFrame:
        from ..functions import text as T
        return df.select("id", T.default_tokenizer(F.col(self.text_col)).alias("toks"))

    def fit(self, train: DataFrame) -> "LikelihoodRatio":
        from .detectors import NotApplicable
        if train.filter(F.col("intent") == self.ood_label).limit(1).count() > 0:
            raise NotApplicable(f"found {self.ood_label!r} in training data; {self.name} needs in-domain rows only")
        self.train = written(self._tokens(train), "tokens")
        self.vocab = written(TO.vocab_build(self.train, F.col("toks")), "vocabulary")
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """(id, score); texts without words have no row."""
        return likelihood_ratio_scores(self.train, self._tokens(df), self.vocab, self.noise, self.p_noise, seed=self.seed)
