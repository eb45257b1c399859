"""Language identification by rank-order profiles.

A text's letters, lower-cased and with every other run of characters as one
blank, give n-grams of 1 to 3 characters. A language's profile is its ``PROFILE``
most frequent n-grams over the training texts, in rank order. A document's own
most frequent ``TOP`` n-grams, in rank order, are compared with each profile: the
out-of-place distance sums the rank differences, with ``PROFILE`` for an n-gram
the profile lacks. The nearest language wins; the score is a softmax over the
mean distances.

Defined results: null texts and texts without a letter are ``und`` with score 0;
equal counts rank by n-gram code, equal distances by language name; without any
training text every document is ``und``; repeated rows count each; texts of any
length are looked at whole; an empty table gives an empty result. Other columns pass
through ``identify``; names must differ from lang_pred and score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD_OUT_FOLD, bounded_sample, by_value, fold, read

by_value(__name__)

PROFILE = 1_000
TOP = 300
UNDETERMINED = "und"
#: Training texts at most (a hash sample beyond it).
TRAIN_ROWS = 40_000
#: Distance per n-gram, in ranks, that divides a language's odds by e.
SOFTNESS = 20.0
BITS = 21  # of a code point


def points_of(text: str | None) -> np.ndarray:
    """Code points of the letters, words set apart by one blank; empty without letters."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at = np.unique(raw, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds])[at]
    if not letter.any():
        return np.empty(0, np.int64)
    p = np.concatenate([[32], np.where(letter, raw, 32), [32]]).astype(np.int64)
    return p[np.concatenate([[True], (p[1:] != 32) | (p[:-1] != 32)])]


def ngrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of 1 to 3 points (no lone blanks) with their counts."""
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (points[:-1] << BITS) | points[1:]
    three = (two[:-1] << BITS) | points[2:]
    return np.unique(np.concatenate([points[points != 32], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:most]]


def counted(batches):
    """(lang, ngram, n) of a task's training texts."""
    for batch in batches:
        sums: dict[str, list] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            sums.setdefault(lang.as_py(), []).append(ngrams(points_of(text.as_py())))
        for lang, parts in sums.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "ngram": codes, "n": n})


def profiles(texts: DataFrame) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams in rank order, from (text, lang) rows.

    PROFILE n-grams a language come to the driver. Counts are combined per batch,
    then by Spark.
    """
    counts = texts.mapInArrow(counted, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["ngram"])
    return {k: np.array(v) for k, v in sorted(found.items())}


class Identifier:
    """Out-of-place distances to the profiles, all languages at once."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.langs = list(learned)
        every = [np.asarray(v) for v in learned.values()]
        self.codes = np.unique(np.concatenate(every)) if every else np.empty(0, np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(every)), -1, np.int64)
        for j, v in enumerate(every):
            self.ranks[np.searchsorted(self.codes, v), j] = np.arange(len(v))

    def __call__(self, text: str | None) -> tuple[str, float]:
        top = ranked(*ngrams(points_of(text)), TOP)
        if not len(top) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = self.ranks[np.where(self.codes[at] == top, at, len(self.codes))]
        places = np.where(ranks < 0, PROFILE, np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), PROFILE))
        mean = places.mean(0)
        odds = np.exp((mean.min() - mean) / SOFTNESS)
        best = int(mean.argmin())
        return self.langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (with text) plus lang_pred and score."""
    def predicted(batches):
        model = Identifier(learned)
        for batch in batches:
            found = [model(t.as_py()) for t in batch.column("text")]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [*rest, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(predicted, f"{fields}, lang_pred string, score double")


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from the rows outside the held-out fold that have text and lang."""
    train = docs.where(fold(F.col("doc_id")) != HELD_OUT_FOLD).where("text is not null and lang is not null")
    return profiles(bounded_sample(train.select("doc_id", "text", "lang"), TRAIN_ROWS, "doc_id").select("text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learned = learn(docs)
    held = docs.select("doc_id", "text", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"))
    return identify(held, learned)
