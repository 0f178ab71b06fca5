"""Operator 6: secret scan by patterns and character Markov models (native).

Three base patterns give labelled spans.  Two first-order character chains, one
of random strings and one of ordinary identifiers, are trained from labelled
samples; every other run of at least ``MIN_TOKEN`` key characters is scored by the
log-likelihood ratio of the two, and becomes a span of kind ``markov`` from
``MIN_RATIO`` on.

Everything is DataFrame functions: matches come from ``regexp_extract_all``, their
places from the lengths of the pieces between them, a score from one fold over a
token's characters.  Training data is bounded by documented parameters: the
``SAMPLE_STRINGS`` base matches of the smallest hash are the random strings, the
identifiers in the usual naming conventions of the ``SAMPLE_DOCS`` documents of the
smallest hash are the ordinary ones.  The trained model is a table over pairs of ASCII characters.

Defined results: null and empty texts have no spans; each row of a repeated or
null doc_id is reported for itself; without labelled strings no span is added; an
empty table gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.  A match of ASSIGN counts with a value of 6
# characters or more, one of ACCESS with 20, one of HEX with 24.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,}"
#: naming conventions that label an identifier as ordinary: camelCase, snake_case, CONSTANT
CONVENTION = "^([A-Za-z]?[a-z]+([A-Z][a-z]+)*[0-9]{0,2}|[a-z]+([_-][a-z0-9]+)+|[A-Z]+([_-][A-Z0-9]+)*)$"
MIN_RATIO = 10.0
SAMPLE_STRINGS = 20_000
SAMPLE_DOCS = 2_000
ALPHABET = 68  # letters, digits and the signs of a key, for the smoothing
BACKING = 8.0  # observations that the single-character frequencies count for
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches, in
    code points.  ``keep(match values)`` may turn matches away by a group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPAN).alias("out"))

    def step(acc, x):
        first = acc["at"] + F.length(x["gap"])
        end = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        wanted = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["value"])
        out = F.coalesce(acc["out"], F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.when(wanted, F.concat(out, F.array(one))).otherwise(out).alias("out"))

    all_spans = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (null: empty), assign, access, hex."""
    t = F.col("text")
    return (docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
            .select("doc_id", "text",
                    spans(t, ASSIGN, 0, lambda v: F.length(v) >= MIN_VALUE).alias("assign"),
                    spans(t, ACCESS, 1).alias("access"), spans(t, HEX, 2).alias("hex")))


# ----------------------------------------------------------------- training

def labelled_strings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(random 0/1, string): the bounded training sample."""
    t = F.coalesce(docs[text], F.lit(""))
    values = F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 16)
    matches = F.concat(values, F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    any_match = t.rlike(ASSIGN) | t.rlike(ACCESS) | t.rlike(HEX)
    strings = (docs.filter(any_match).select(F.explode(matches).alias("s")).distinct()
               .orderBy(F.xxhash64("s"), "s").limit(SAMPLE_STRINGS))
    # hashes first, then the texts of the chosen (at most SAMPLE_DOCS) hashes
    hashed = docs.select(F.xxhash64(docs[key], t).alias("h"), t.alias("t"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = (hashed.join(F.broadcast(chosen), "h").dropDuplicates(["h"])
                .select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("s"))
                .filter(F.col("s").rlike(CONVENTION)))
    return strings.select(F.lit(1).alias("random"), "s").unionByName(ordinary.select(F.lit(0).alias("random"), "s"))


def train(strings: DataFrame) -> list[float]:
    """Log-likelihood ratios of the character pairs: entry ``128 * before + after``
    (ASCII codes; 0 stands before the first)."""
    chars = strings.select("random", F.transform(F.split("s", ""), F.ascii).alias("c")).filter("size(c) > 0")
    pairs = chars.select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("c")).alias("a"), F.col("c").alias("b"))).alias("p"))
    counts = (pairs.filter("p.b IS NOT NULL AND p.a BETWEEN 0 AND 127 AND p.b BETWEEN 1 AND 127")
              .groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).count())
    table = [[[0] * 128 for _ in range(128)] for _ in range(2)]
    for r in counts.collect():  # at most 2 * 128 * 128 rows
        table[r["random"]][r["a"]][r["b"]] = r["count"]
    if not all(any(map(any, t)) for t in table):
        return [0.0] * (128 * 128)

    after = [[sum(row[b] for row in t) for b in range(128)] for t in table]
    before = [[sum(row) for row in t] for t in table]

    def chance(kind: int, a: int, b: int) -> float:
        """Pair frequencies, backed by those of the single characters."""
        single = (after[kind][b] + 1) / (sum(after[kind]) + ALPHABET)
        return math.log((table[kind][a][b] + BACKING * single) / (before[kind][a] + BACKING))

    return [round(chance(1, a, b) - chance(0, a, b), 3) for a in range(128) for b in range(128)]


# ------------------------------------------------------------------ scoring

def ratio(token: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio of an ASCII token: one fold over its characters."""
    model = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to a constant
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        code = F.ascii(c)
        return F.struct(code.alias("before"), (acc["sum"] + F.get(model, acc["before"] * 128 + code)).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"])


def find_secrets(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and all: sorted spans (start, kind, end) of each row."""
    based = base_spans(docs, key, text).select("doc_id", "text", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
                                               F.size("hex").cast("long").alias("n_hex"), F.array_sort(F.concat("assign", "access", "hex")).alias("base"))
    tokens = F.arrays_zip(spans(F.col("text"), TOKEN, 3).alias("span"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("token"))
    judged = F.filter(tokens, lambda x: (ratio(x["token"], weights) >= MIN_RATIO) & ~F.exists(
        "base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])))
    added = F.when(F.col("text").rlike(TOKEN), F.transform(judged, lambda x: x["span"])).otherwise(F.array().cast(SPAN))
    return based.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", added)).alias("all"))


def _joined(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    weights = train(labelled_strings(docs, key, text))
    found = find_secrets(docs, weights, key, text)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"))
