"""URL filter: host/path rules first, gradient-boosted trees for the rest.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule, and gets the model's verdict on its (zero) features. Without
labelled URLs the verdict is ``allow``; with labels of one kind, that kind.
Repeated rows are judged alike. Extra columns are ignored by the query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_sample, read

# Fixed rules of the query: (verdict, host, path start).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs the trees are fitted on, at most (a hash sample beyond it).
TRAIN_ROWS = 200_000
#: Weight of the overall block rate in a suffix's smoothed block rate.
PRIOR = 20.0
FEATURES = ("f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params",
            "f_labels", "f_hyphens", "f_fragment", "f_suffix_rate", "f_suffix_rows")


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring_index(
        F.substring_index(F.expr("substring(url, locate('://', url) + 3)"), "#", 1), "?", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.length(host) + 1)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and ``rule_verdict`` of the longest rule that fits, else null."""
    def fits(host: str, path: str) -> Column:
        h = F.col("host")
        return ((h == host) | h.endswith("." + host)) & F.col("path").startswith(path)

    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: reduce(
        lambda c, r: c.when(fits(r[1], r[2]), F.lit(value(r))), by_length[1:],
        F.when(fits(*by_length[0][1:]), F.lit(value(by_length[0])))) if by_length else F.lit(None).cast("string")
    return df.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn(
        "rule_verdict", pick(lambda r: r[0]))


def with_features(df: DataFrame) -> DataFrame:
    """Lexical features of ``url``, ``host`` and ``path`` (doubles)."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(u).cast("double")
    count = lambda c, of: (F.length(of) - F.length(F.replace(of, F.lit(c)))).cast("double")
    query = F.substring_index(F.substring_index(u, "#", 1), "?", -1)
    has_query = F.substring_index(u, "#", 1).contains("?")

    def plogp(c: Column) -> Column:
        p = (n - F.length(F.replace(u, c))) / n
        return -p * F.log2(p)

    entropy = F.aggregate(F.array_distinct(F.split(u, "")), F.lit(0.0),
                          lambda a, c: a + F.when(c != "", plogp(c)).otherwise(0.0))
    digits = (n - F.length(F.translate(u, "0123456789", ""))) / F.greatest(n, F.lit(1.0))
    return df.select(
        "*", n.alias("f_length"), F.length("host").cast("double").alias("f_host_length"),
        count("/", F.col("path")).alias("f_depth"), digits.alias("f_digits"),
        F.when(n > 0, entropy).otherwise(0.0).alias("f_entropy"),
        F.when(has_query, count("&", query) + 1.0).otherwise(0.0).alias("f_params"),
        count(".", F.col("host")).alias("f_labels"), count("-", u).alias("f_hyphens"),
        u.contains("#").cast("double").alias("f_fragment"),
        F.substring_index("host", ".", -1).alias("suffix"))


def url_verdicts(pages: DataFrame, rules=RULES, *, rounds: int = 12, depth: int = 3) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, p_block (the trees' block
    probability), one row per page.

    The URLs that a rule decides are the labelled ones: the trees learn from
    them and judge the others. Suffix statistics (smoothed block rate and row
    count of the host's last label) are an aggregate over all labelled URLs;
    only the tree fit may use a bounded sample (``TRAIN_ROWS``).
    """
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", F.col("url"), host.alias("host"), path.alias("path"))
    rows = with_features(with_rule(base, rules))
    block = (F.col("rule_verdict") == "block").cast("double")
    labelled = rows.where(F.col("rule").isNotNull())
    by_suffix = labelled.groupBy("suffix").agg(F.count("*").alias("n"), F.sum(block).alias("n_block"))
    kinds = by_suffix.agg(F.sum("n"), F.sum("n_block")).first()
    total, blocked = kinds[0] or 0, kinds[1] or 0.0
    rate = blocked / total if total else 0.0
    if rate in (0.0, 1.0):  # nothing to tell apart
        return rows.select("page_id", "host", "path", "rule", F.coalesce(
            "rule_verdict", F.lit("block" if rate else "allow")).alias("verdict"),
            F.lit(rate).alias("p_block"))
    stats = by_suffix.select(
        "suffix", ((F.col("n_block") + PRIOR * rate) / (F.col("n") + PRIOR)).alias("rate"),
        F.log1p("n").alias("rows"))

    def assembled(df: DataFrame) -> DataFrame:
        full = df.join(stats, "suffix", "left").withColumn(
            "f_suffix_rate", F.coalesce("rate", F.lit(rate))).withColumn(
            "f_suffix_rows", F.coalesce("rows", F.lit(0.0)))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)

    train = assembled(bounded_sample(labelled, TRAIN_ROWS, "page_id", "url")).select(
        "features", block.alias("label"))
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7).fit(train)
    p = vector_to_array(F.col("probability"))[1]
    return model.transform(assembled(rows)).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(p >= 0.5, "block").otherwise("allow")).alias("verdict"),
        p.alias("p_block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"))
