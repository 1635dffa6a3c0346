"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Texts become tokens, runs of letters and digits or runs of ASCII punctuation; unigrams and bigrams are hashed into
BUCKETS buckets. Two multinomials over the buckets, smoothed by ALPHA, are counted over whole tables: the target over
all trusted documents, the raw one over all documents. A document's score is the sum of log(target / raw) over its
n-grams, divided by their number; it is kept at THRESHOLD and above, if no base rule fails.

Trusted ids are broadcast where their count is at most BROADCAST_IDS, and joined by shuffle beyond it. The table of
log ratios has BUCKETS entries, whatever the corpus.

Defined results: null text counts as empty: no words, every count 0, score 0, base_failed true. Ties don't arise: each
row is judged alone. Repeated rows each get a row, and each count; a null id is never trusted. With no trusted document
all scores are those of two multinomials of which one is flat. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import words

BUCKETS = 1 << 14
ALPHA = 1.0
#: Least length-normalised log-likelihood ratio of a kept document.
THRESHOLD = -0.4
BROADCAST_IDS = 1_000_000
#: Limits of the base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
_PUNCTUATION = "".join(rf"\x{n:02X}" for n in range(0x21, 0x7F) if not chr(n).isalnum())
_OTHERS = "".join(rf"\x{n:02X}" for n in [*range(0x21), 0x7F])
#: Characters are listed one by one, which Java's patterns look up in one step; ranges are tried in turn.
TOKEN = f"([^{_OTHERS}{_PUNCTUATION}]+|[{_PUNCTUATION}]+)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngram_buckets(text: Column) -> Column:
    """The buckets of a text's unigrams and bigrams."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), lambda t: F.xxhash64(t))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: bucket(F.xxhash64(a, b)))
    both = lambda h: F.concat(F.transform(h, bucket), F.slice(pairs(h), 1, F.greatest(F.size(h) - 1, F.lit(0))))
    return let(hashes, both)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text") -> DataFrame:
    """One row: ratios, an array of log(target / raw) by bucket. trusted: doc_id of the trusted documents."""
    ids = trusted.select(F.col("doc_id").alias("_trusted")).filter("_trusted IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(ids, F.col("doc_id") == F.col("_trusted"), "left")
    grams = marked.select(F.explode(ngram_buckets(F.col("_text"))).alias("bucket"), F.col("_trusted").isNotNull().cast("long").alias("_own"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_own").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counted), "bucket", "left")
    rows = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))))
    totals = every.agg(rows.alias("rows"), F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"))
    share = lambda n, total: (n + ALPHA) / (total + ALPHA * BUCKETS)
    ratio = lambda x: F.log(share(x["target"], F.col("t")) / share(x["raw"], F.col("r")))
    return totals.select(F.transform("rows", ratio).alias("ratios"))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of three words that stands twice or more in the text; hashes of the words in order."""

    def windows(h: Column) -> Column:
        starts = F.when(F.size(h) >= 3, F.sequence(F.lit(0), F.size(h) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def counted(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(ordered, _covered))

    return let(let(hashes, windows), counted).cast("long")


def _covered(ordered: Column) -> Column:
    """Words that the repeated windows of an array (hash, start), sorted, cover."""
    same = lambda s, k: F.coalesce(F.get(ordered, k)["x"] == s["x"], F.lit(False))
    again = F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    table = log_ratios(docs, trusted, text).first()["ratios"]  # BUCKETS numbers
    ratio = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folded into one constant
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    rows = docs.select("doc_id", words(F.col(text)).alias("_words"), lines.alias("_lines"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), ngram_buckets(whole).alias("_grams"))
    total = F.aggregate("_grams", F.lit(0.0), lambda s, b: s + F.get(ratio, b))
    rows = rows.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.transform("_words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
        F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
