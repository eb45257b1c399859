import math

import numpy as np
from pyspark.sql import functions as F

from relyscope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    fit = [(i, tuple(math.floor(1024 * float(np.float32(e))) for e in v)) for i, v, _ in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(x) for _, x in fit), default=0)
    full = [(i, np.array(x + (0,) * (width - len(x)), dtype=object)) for i, x in fit]
    out = []
    for n, (q, x) in enumerate(full):
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for m, (i, y) in enumerate(full) if m != n))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def searched(spark, rows, k=10):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 100 == 0, k).collect())


def sample():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * rng.standard_normal(12)).tolist(), 0) for i in range(700)]
    same = rows[0][1]
    rows += [(1000 + i, same, 0) for i in range(300)]  # ties
    return rows + [(2000, None, 0), (2100, [], 0), (2200, [1.0, None], 0), (2300, [float("nan")] * 12, 0), (2400, [float("inf")] * 12, 0),
                   (None, same, 0), (5, rows[6][1], 0), (2500, [0.5, -0.25], 0), (2600, [0.0] * 12, 0)]


def test_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rows = sample()
    assert searched(spark, rows) == brute(rows, 10)


def test_every_row_is_a_candidate(spark):
    rows = [(1, [0.5, 0.5], 0), (1, [0.9, 0.1], 0), (2, [0.2, 0.2], 0), (100, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (100, [0.0, 1.0], 0)]
    got = searched(spark, rows)
    assert got == brute(rows, 10)
    assert len(got) == 3 * 5


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(4) * 500_000).tolist(), 0) for i in range(300)]
    got = searched(spark, rows)
    assert got == brute(rows, 10)
    assert max(r[3] for r in got) > topk.EXACT


def test_far_blocks_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "BOUNDS", 5)
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((30, 16))
    # a query's own group is as large as k and points its way
    rows = [(i, (v / np.linalg.norm(v)).tolist(), 0) for i in range(3000) for v in [centre[i // 100] + 0.03 * rng.standard_normal(16)]]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    result, pairs, every = topk.search(vectors, F.col("vec_id") % 100 == 0, 10)
    assert sorted(map(tuple, result.collect())) == brute(rows, 10)
    assert pairs.count() < 0.5 * every


def test_few_vectors(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0], 0)]) == []
    assert searched(spark, [(0, [1.0], 0), (7, [2.0], 0)]) == [(0, 1, 7, 1024 * 2048)]
    assert searched(spark, [(1, [1.0], 0), (7, [2.0], 0)]) == []


def test_bound_order_stops_early_and_exactly():
    rng = np.random.default_rng(6)
    x = np.floor(rng.standard_normal((4000, 3)) * 300)
    most = float((x ** 2).sum(1).max())
    lift = lambda v: np.sqrt(np.maximum(most - (v ** 2).sum(1), 0))
    pivots = topk.far_apart(np.concatenate([x, lift(x)[:, None]], 1), topk.PIVOTS)
    dx = topk.to_pivots(x, lift(x), pivots)
    q = x[0]
    ids, scores = topk.best(q, 0, topk.to_pivots(q[None], np.zeros(1), pivots)[0], x, np.arange(4000), np.arange(4000), dx, most, 10, -np.inf)
    order = np.lexsort((np.arange(4000), -(x @ q)))
    order = order[order != 0][:10]
    assert ids.tolist() == order.tolist() and (scores == (x @ q)[order]).all()
