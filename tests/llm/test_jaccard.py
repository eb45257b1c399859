import random

import numpy as np

from relyscope.llm import jaccard
from relyscope.llm.components import components

from .helpers import Roots, docs, prose, vocabulary, words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    sets = {}
    for d, t, *_ in rows:
        sets.setdefault(shingles(t), []).append(d)
    found = [s for s in sets if s]
    roots = Roots(found)
    for i, x in enumerate(found):
        for y in found[:i]:
            if 100 * len(x & y) >= 75 * len(x | y):
                roots.up[roots(x)] = roots(y)
    least = {}
    for s in found:
        least[roots(s)] = min(least.get(roots(s), 1 << 60), *sets[s])
    return [(d, len(shingles(t)), least[roots(shingles(t))] if shingles(t) else d) for d, t, *_ in rows]


def sample(n=150):
    rng = random.Random(11)
    v = vocabulary(12, 200)
    passage = prose(rng, 60, v)
    base = [prose(rng, rng.randint(3, 120), v) for _ in range(12)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split(" ") if rng.random() < 0.7 else prose(rng, rng.randint(1, 90), v).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(v)
        text = " ".join(w) + (" " + passage if rng.random() < 0.4 else "")
        rows.append((1000 - i, rng.choice([text, text.upper(), text.replace(" ", "\n\t")]), "en", "s"))
    return rows + [(2000, None, None, None), (2001, "", "en", "s"), (2002, "\x0b \n", "en", "s"), (2003, "a b", "en", "s"),
                   (2004, "A  B", "en", "s"), (2005, "a", "en", "s"), (1000, rows[0][1], "en", "s"),
                   (2006, prose(rng, 20_000, v), "en", "s"), (2007, "É é", "en", "s"), (2008, "é é", "en", "s")]


def result(spark, rows, monkeypatch, tmp):
    monkeypatch.setattr(jaccard, "read", lambda *_: docs(spark, rows).withColumnRenamed("lang", "node"))
    return sorted(tuple(r) for r in jaccard.op10_jaccard_join(spark, tmp).select("doc_id", "n_shingles", "component_id").collect())


def test_against_all_pairs(spark, monkeypatch):
    rows = sample()
    assert result(spark, rows, monkeypatch, "") == sorted(brute(rows))


def test_frequent_tokens_and_small_blocks_change_nothing(spark, monkeypatch):
    """Everything frequent, blocks of two: other paths, same components."""
    monkeypatch.setattr(jaccard, "frequent_buckets", lambda info: np.arange(jaccard.CHUNK * jaccard.CHUNKS) % 2 == 0)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rows = sample(70)
    assert result(spark, rows, monkeypatch, "") == sorted(brute(rows))


def test_stage_keeps_one_of_each(spark):
    rows = sample(60)
    want = {d for d, n, c in brute(rows) if d == c}
    got = jaccard.one_of_each(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    ids = [r.doc_id for r in got.collect()]
    assert set(ids) == want and len(ids) == len(want)
    assert jaccard.one_of_each(docs(spark, [])).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 200), (301, 300), (300, 301)]
    rng.shuffle(edges)
    roots = Roots({x for e in edges for x in e})
    for a, b in edges:
        roots.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: roots(x) for x in roots.up if x != 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
