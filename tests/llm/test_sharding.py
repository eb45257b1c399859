import random
import zlib
from itertools import product

import numpy as np

from relyscope.llm import sharding

from .helpers import docs, prose, vocabulary


def test_groups_whole_sizes_even_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 16)  # heavy groups and shared items both occur
    rng = random.Random(7)
    v = vocabulary(14)
    rows = [(i, prose(rng, rng.randint(1, 60), v), "en", "s") for i in range(900)]
    rows += [(i, rows[5][1], "en", "s") for i in range(2000, 2010)] + [(3000, None, None, None), (3001, "", "en", "s"), (3002, "é" * 50, "en", "s"),
             (3003, None, "en", "s"), (5, rows[5][1], "en", "s"), (None, "null id", "en", "s")]
    got = sharding.shard_documents(docs(spark, rows).withColumnRenamed("lang", "size")).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    by_text = {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for k, s in by_text.items() if k != (0, 16))  # null and empty texts look alike here
    shards = [[r for r in got if r.shard == k] for k in range(40)]
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards)
    sums = [sum(r.size for r in s) for s in shards]
    assert max(sums) - min(sums) <= 0.02 * np.mean(sums)


def test_a_group_larger_than_a_shard_has_one_alone(spark):
    rows = [(i, "same text " * 9, "en", "s") for i in range(50)] + [(100 + i, f"text number {i}", "en", "s") for i in range(200)]
    got = sharding.shard_documents(docs(spark, rows), shards=8).collect()
    shards = [[r for r in got if r.shard == k] for k in range(8)]
    big = next(s for s in shards if any(r.doc_id < 100 for r in s))
    assert len(big) == 50 and all(r.doc_id < 100 for r in big)
    others = [sum(r.size for r in s) for s in shards if s is not big]
    assert max(others) - min(others) <= 0.1 * np.mean(others)


def test_differencing_against_all_partitions():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 60, 8)
        parts = np.zeros((8, 2), np.int64)
        parts[:, 0] = sizes
        labels, sums = sharding.difference(parts)
        assert sorted(sums) == sorted(sizes[labels[:, 0] == k].sum() for k in (0, 1))
        best = min(abs(2 * sizes[np.array(c) == 1].sum() - sizes.sum()) for c in product((0, 1), repeat=8))
        assert abs(sums[0] - sums[1]) <= best + sizes.max() / 2


def test_one_row_and_none(spark):
    r = sharding.shard_documents(docs(spark, [(1, "x", "en", "s")])).collect()
    assert len(r) == 1 and r[0].slot == 0
    assert sharding.shard_documents(docs(spark, [])).count() == 0
