import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from relyscope.llm import toxicity

from .helpers import docs, prose, vocabulary


def test_held_out_scores_and_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    rng = random.Random(3)
    clean, bad = vocabulary(6), ["vexxu" + w for w in vocabulary(7, 30)]
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, rng.randint(5, 40), clean).split(" ")
        if i % 4 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad).title() + "."
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, " \n", "en", "s"), (None, "vexxuabc", "en", "s"), (0, rows[0][1], "en", "s")]
    d = docs(spark, rows + odd)
    marked = spark.createDataFrame(labels + [(1000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(d, marked)
    ids = d.select("doc_id", F.lit("x").alias("score"), F.lit(1).alias("predicted"), F.lit("y").alias("a.b"), toxicity.hashed_ids(F.col("text")).alias("ids"))
    got = toxicity.score_documents(ids, model).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))


def test_shared_passes_equal_single_ones():
    net, rng = toxicity.Network(), np.random.default_rng(1)
    some = [rng.integers(1, toxicity.BUCKETS, (n, toxicity.IDS)) for n in (0, 1, 2, 7, 300, toxicity.SEGMENT + 10)]
    single = [net.pooled(d) @ net.p["V"] + net.p["c"][0] for d in some]
    assert np.allclose(net.logits(some), single, atol=1e-4)


def test_one_kind_of_label(spark):
    d = docs(spark, [(1, "a b", "en", "s")])
    assert toxicity.learn(d, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")) is None
    ids = d.select("doc_id", toxicity.hashed_ids(F.col("text")).alias("ids"))
    assert toxicity.score_documents(ids, None).first().score == 0.0


def test_long_texts_and_repeated_ids_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 30)
    rng = random.Random(4)
    v = vocabulary(6)
    seen = {}
    monkeypatch.setattr(toxicity, "Model", lambda rows: seen.setdefault("rows", rows))
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 not in (2, toxicity.CALIBRATION_FOLD)]
    rows = [(train[0], prose(rng, 10_000, v), "en", "s")] + [(train[1], f"some words {i}", "en", "s") for i in range(1000)]
    rows += [(i, prose(rng, 20, v), "en", "s") for i in train[2:8]]
    labels = spark.createDataFrame([(i, 1, n % 2) for n, i in enumerate(train[:8])], "doc_id long, quality int, toxic int")
    toxicity.learn(docs(spark, rows), labels)
    sizes = sorted(len(r[0]) for r in seen["rows"])
    assert sizes == [3] + [20] * 6 + [toxicity.TRAIN_WORDS]
    ids = toxicity.hashed_ids(F.col("text"))
    whole, part = docs(spark, rows[:1]).select(ids.alias("ids"), "doc_id").select("ids", toxicity.trained_words(F.col("ids"), F.col("doc_id")).alias("p")).first()
    own = toxicity.TRAIN_WORDS // toxicity.WINDOWS * toxicity.IDS
    text = ",".join(map(str, whole))
    at = [text.find(",".join(map(str, part[k:k + own]))) for k in range(0, len(part), own)]
    assert at == sorted(at) and at[0] >= 0 and len(set(at)) == toxicity.WINDOWS


def test_empty_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, [])
    assert toxicity.learn(d, labels) is None
    assert toxicity.score_documents(d.select("doc_id", toxicity.hashed_ids(F.col("text")).alias("ids")), None).collect() == []


def test_every_labelled_document_counts(spark, monkeypatch):
    """Words of documents outside the sample that training starts with are learned, and
    thresholds and languages come from all documents."""
    monkeypatch.setattr(toxicity, "STEPS", 60)
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 20)
    monkeypatch.setattr(toxicity, "ROUNDS", 8)
    monkeypatch.setattr(toxicity, "LATER_RATE", 0.02)
    rng = random.Random(8)
    clean, bad = vocabulary(6), ["vexxu" + w for w in vocabulary(7, 40)]
    rows, labels = [], []
    for i in range(1200):
        text = prose(rng, 12, clean).split(" ")
        if i % 3 == 0:
            text[rng.randrange(12)] = bad[i // 3 % 40][::-1]  # no common beginning: each word has to be seen
        rows.append((i, " ".join(text), "l%d" % (i % 50), "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model.languages.names) == 50
    got = toxicity.score_documents(docs(spark, rows).select("doc_id", toxicity.hashed_ids(F.col("text")).alias("ids")), model).collect()
    held = [r.predicted == (r.doc_id % 3 == 0) for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(held) > 0.85


def test_threshold_of_counts_has_the_best_f1():
    counts = np.array([[0, 512, 3, 3], [1, 256, 2, 1], [0, 0, 10, 1], [0, -256, 50, 0]])
    assert toxicity.threshold(counts[:1]) == 1.5 and toxicity.threshold(counts) == 257 / 512
