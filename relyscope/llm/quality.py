"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio
(DataFrame functions only).

Words and pairs of neighbouring words of every whole text are hashed into
``BUCKETS`` buckets, three quarters of them for words. Two multinomials over the
buckets are counted from all documents: the trusted target (documents labelled
quality 1) and the raw corpus, its counts scaled to the target's total. Both are
smoothed by ``PRIOR`` more per bucket, so that buckets with little evidence say
little. A document's score is the sum over its n-grams of log(p_target / p_raw),
divided by their number. A document that passes the base
rules is kept if its score reaches ``THRESHOLD``, a fixed loss a n-gram: the same
document against the same counts always meets the same verdict.

Defined results: null and blank texts have no words, score 0, and fail the base
rules; a text of one word has one n-gram; without trusted documents (empty
labels) the base rules alone decide. Repeated rows are judged alike and each
counts. Null doc_ids are judged like others and are never trusted. Columns other
than doc_id and text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, read, stored, words

#: Size of the model, gathered as one row: two counts a bucket.
BUCKETS = 1 << 16
PRIOR = 10.0
#: Natural-log units a n-gram. Clean text scores near 0 whether it is labelled or
#: not; text that trusted documents lack loses far more.
THRESHOLD = -0.1
MIN_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def ngram_buckets(h: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours, from word hashes."""
    for_words = BUCKETS * 3 // 4
    pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: (
        for_words + F.pmod(F.xxhash64(F.get(h, i), x), F.lit(BUCKETS - for_words))).cast("int"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(for_words)).cast("int")), pairs)


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` (long) and the word hashes ``_h``.

    Words in repeated windows: windows are hashed; if some hash repeats, they are
    sorted with their places, places whose hash equals a neighbour's are repeated,
    and in order of place each covers min(WINDOW, distance to the next) words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h, o, p = F.col("_h"), F.col("_ordered"), F.col("_places")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    start = docs.select(
        "*", word_hashes(text).alias("_h"), lines.alias("_lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"))
    last = F.size(h) - WINDOW
    keyed = start.select(
        "*", F.size(h).cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(last > 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).alias("_keys")).drop("_lines")
    some = F.size("_keys") > F.size(F.array_distinct("_keys"))
    ordered = keyed.select("*", F.when(some, F.sort_array(F.transform(
        "_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).alias("_ordered")).drop("_keys")
    beside = lambda x, j: F.coalesce(F.get(o, j)["k"] == x["k"], F.lit(False))
    placed = ordered.select("*", F.sort_array(F.transform(
        F.filter(o, lambda x, j: beside(x, j - 1) | beside(x, j + 1)), lambda x: x["i"])).alias("_places")).drop("_ordered")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(
        F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    return placed.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()


def model(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row, ``llr``: the log ratio by bucket (all 0 without trusted n-grams)."""
    # labels grow with the corpus: one merge join at any size
    marked = docs.select("doc_id", "text").join(trusted.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left")
    counts = marked.select(F.col("_trusted").isNotNull().cast("long").alias("t"), word_hashes(F.col("text")).alias("h")
                           ).select("t", F.explode(ngram_buckets(F.col("h"))).alias("b")).groupBy("b").agg(
        F.count("*").alias("raw"), F.sum("t").alias("target"))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select(
        "b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = dense.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"),
                    F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    share = F.col("n_target") / F.col("n_raw")
    ratio = lambda x: F.log((x["target"] + PRIOR) / (x["raw"] * share + PRIOR))
    return one.select(F.transform("all", lambda x: F.when(F.col("n_target") > 0, ratio(x)).otherwise(0.0).cast("float")).alias("llr"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``COUNTS``, ``score`` (double) and booleans base_failed, kept."""
    fitted = stored(model(docs, trusted_ids(labels)), "ngrams")
    b, llr = F.col("_b"), F.col("_llr")
    total = F.aggregate(b, F.lit(0.0), lambda s, x: s + F.get(llr, x))
    rows = (with_counts(docs).select("*", ngram_buckets(F.col("_h")).alias("_b")).drop("_h")
            .withColumn("_llr", fitted.scalar())  # a lambda can't hold the subquery itself
            .select("*", F.when(F.size(b) > 0, total / F.size(b)).otherwise(0.0).alias("score"))
            .drop("_b", "_llr"))
    failed = base_failed()
    return rows.select("*", failed.alias("base_failed"), (~failed & (F.col("score") >= THRESHOLD)).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, read(spark, sf_dir, "labels"))
    return rows.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The number of a row is no verdict, but a filter that reads it stays above the
    counts: pushed below, it would repeat their expressions inside each other.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")  # no names to clash
    verdicts = scored(docs.select("doc_id", "text", rest), labels).select("row", "text", "kept", F.monotonically_increasing_id().alias("at"))
    return verdicts.where("kept and at >= 0").select(
        *["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
