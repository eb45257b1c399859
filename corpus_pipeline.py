"""Corpus pipeline: five training-data operators in a row over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet in the shared checkpoint folder and read back as the next stage's
``docs``. All but the last return the columns of ``docs``, whatever their names; the
last returns a row a packed piece.

Defined results: a null or empty text fails the quality rules (no words) and goes
there; without trusted labels only the base rules decide; repeated rows fall to line
dedup or the Jaccard stage, the smallest doc_id stays (ties: line number, row hash);
texts of any length are handled whole; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relyscope.llm import jaccard, linededup, mixing, packing, quality
from relyscope.llm.common import read, stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail them go."""
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and documents that held nothing else."""
    return linededup.fresh_documents(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each linked group stays."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target takes it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into training sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_one),
    ("source_mix", mix),
    ("packing", pack),
]

#: Model scores, SimHash and packing have no DuckDB form; see tests/llm/.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
