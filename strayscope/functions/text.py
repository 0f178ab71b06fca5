"""Text column functions: cleaning, tokenising, RAKE phrase splitting.

All are built-in Spark expressions (regex + higher-order array functions), so
they run inside whole-stage codegen with no Python in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: text-cleaning patterns of the reference (URL -> whole text
# dropped, e-mail addresses removed, decimal digits removed, word tokens)
URL_PATTERN = r"\S*https?:\/\/.*[\r\n]*"
EMAIL_PATTERN = r"\S*[a-zA-Z0-9+_.-]+@[a-zA-Z0-9.-]+\S*"
DIGIT_PATTERN = r"\p{Nd}"
WORD_PATTERN = r"[\p{L}\p{N}_]+"
BOW_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# fixed values: English stop-word list used by the RAKE phrase splitter
# (the classic 179-word NLTK English list)
RAKE_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't "
    "couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn "
    "mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't "
    "wouldn wouldn't"
).split()

# fixed values: custom keyword stop-list applied after RAKE
KEYWORD_STOPWORDS = ("want", "my", "send", "much", "please", "plz", "need", "know", "name", "tell", "help",
                     "ok", "okay", "is", "was", "wa", "I", "am", "were", "are", "will", "should")

_SEP = "\u0001"


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and bind it in ``body`` (a one-argument lambda):
    keeps an expensive regex chain from being re-evaluated for every reference."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def strip_url_text(c: Column) -> Column:
    """Whole text becomes '' when it contains a URL (cheap substring test
    first: the pattern can only match where '://' occurs)."""
    return let(c, lambda x: F.when((F.instr(x, "://") > 0) & x.rlike(URL_PATTERN), F.lit("")).otherwise(x))


def strip_email(c: Column) -> Column:
    """Remove e-mail-like runs (only texts containing '@' pay for the regex)."""
    return let(c, lambda x: F.when(F.instr(x, "@") > 0, F.regexp_replace(x, EMAIL_PATTERN, "")).otherwise(x))


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, DIGIT_PATTERN, "")


def word_tokens(c: Column, pattern: str = WORD_PATTERN) -> Column:
    """Unicode word tokens (``\\w+``) of ``c``; null text -> null."""
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def default_tokenizer(c: Column) -> Column:
    """Lower-cased word tokens (the library's default ``tok_fn``)."""
    return word_tokens(F.lower(c))


def rake_tokens(text: Column, max_tokens: int | None = None,
                lemma: Column | None = None) -> Column:
    """Cleaning chain of the keyword detector: URL text dropped, lower case,
    e-mails and digits removed, word tokens.  Every text keeps all its tokens unless
    ``max_tokens`` is given, which empties longer ones.  (Lemmatisation is an optional map column ``lemma``.)"""
    t = strip_digits(strip_email(let(text, lambda x: F.lower(strip_url_text(x)))))
    toks = word_tokens(t)
    if max_tokens is not None:
        toks = let(toks, lambda w: F.when(F.size(w) > max_tokens, F.array().cast("array<string>")).otherwise(w))
    if lemma is not None:
        toks = F.transform(toks, lambda w: F.coalesce(F.element_at(lemma, w), w))
    return toks


def rake_text(tokens: Column) -> Column:
    """Processed utterance string: tokens joined by single spaces plus a trailing
    space (empty string when there are no tokens)."""
    return let(tokens, lambda t: F.when(F.size(t) > 0, F.concat(F.array_join(t, " "), F.lit(" "))).otherwise(F.lit("")))


def rake_phrases(tokens: Column, stopwords=RAKE_STOPWORDS) -> Column:
    """Maximal runs of non-stop-word tokens, each joined by single spaces."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    marked = F.transform(tokens, lambda w: F.when(F.array_contains(stop, w), F.lit(_SEP)).otherwise(w))
    parts = F.split(F.array_join(marked, " "), _SEP)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def pos_to_wordnet(tag: Column) -> Column:
    """Penn tag initial -> WordNet POS letter (default noun)."""
    first = F.substring(tag, 1, 1)
    return (F.when(first == "J", "a").when(first == "V", "v").when(first == "N", "n")
            .when(first == "R", "r").otherwise("n"))
