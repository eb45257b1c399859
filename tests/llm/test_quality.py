import math
import random
from collections import Counter

import xxhash

from relyscope.llm import quality

from .helpers import docs, prose, vocabulary, words


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_word(w):
    return xxhash.xxh64_intdigest(w.encode(), seed=42)


def hash_pair(a, b):
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=first))


def grams(text):
    h = [hash_word(w) for w in words(text)]
    own = quality.BUCKETS * 3 // 4
    return [signed(x) % own for x in h] + [own + hash_pair(a, b) % (quality.BUCKETS - own) for a, b in zip(h, h[1:])]


def counts(text):
    w, text = words(text), text or ""
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def sample():
    rng = random.Random(1)
    clean, junk = vocabulary(1), [w.upper() + "!!" for w in vocabulary(2, 12)]
    rows = [(i, prose(rng, rng.randint(25, 80), clean), "en", "a") for i in range(30)]
    rows += [(100 + i, prose(rng, 60, junk), "en", "a") for i in range(25)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \t\n\x0b ", "en", "a"), (203, "one", "en", "a"),
             (204, "a b c d e f g h i " * 5, "en", "b"), (205, "x\ny\nx\n\nx #|<é>", "en", "b"),
             (206, "p q r s t u v w " * 3000, "en", "b"), (0, rows[0][1], "en", "a"), (None, rows[1][1], "en", "a")]
    labels = [(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(5)] + [(0, 1, 0), (None, 1, 0), (300, None, None)]
    return rows, labels


def test_counts_score_and_verdict(spark):
    rows, labels = sample()
    got = quality.scored(docs(spark, rows).withColumnRenamed("lang", "score_"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")).collect()
    trusted = {d for d, q, _ in labels if q == 1 and d is not None}
    raw, target = Counter(), Counter()
    for d, text, *_ in rows:
        raw.update(grams(text))
        if d in trusted:
            target.update(grams(text))
    share = sum(target.values()) / sum(raw.values())
    assert len(got) == len(rows)
    texts = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for r, (d, text, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")), texts):
        assert tuple(r[c] for c in quality.COUNTS) == counts(text)
        g = grams(text)
        llr = sum(math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR)) for b in g) / len(g) if g else 0
        assert abs(r.score - llr) < 1e-5
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.score >= quality.THRESHOLD)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(30)) <= kept and not kept & set(range(100, 125))


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, _ = sample()
    kept = quality.good_documents(docs(spark, rows), labels)
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} >= {*range(30), *range(100, 125)}
    assert quality.good_documents(docs(spark, []), labels).count() == 0
