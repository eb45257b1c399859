"""Prefix rows of the Jaccard join move packed; blocks may reach over batches."""

import random

import numpy as np
import pyarrow as pa

from relyscope.llm import jaccard

from .helpers import prose, vocabulary


def batches(texts, size):
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "key": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return table.to_batches(max_chunksize=size)


def corpus():
    rng = random.Random(3)
    v = vocabulary(2, 30)
    texts = [None, "", "  ", "One", "one two", "a b c d", "a b c d e"] + [prose(rng, rng.randint(1, 80), v) for _ in range(400)]
    return texts + texts[10:60]


def test_packed_prefix_rows_are_all_prefix_rows(monkeypatch):
    monkeypatch.setattr(jaccard, "DEALS", 16)
    monkeypatch.setattr(jaccard, "MANY", 1_000)
    texts = corpus()
    flags = np.random.default_rng(1).random(jaccard.CHUNK * jaccard.CHUNKS) < 0.3
    want = set()
    for t in jaccard.token_sets(pa.array(texts, pa.string())):
        if len(t):
            often, n = flags[jaccard.bucket_of(t)], len(t)
            p = n - -(-3 * n // 4) + 1
            node = jaccard.node_of(t)
            ordered = [(int(x), 0) for x in t[~often].view(np.int64)] + [(int(x), 1 + node % jaccard.SALTS) for x in t[often].view(np.int64)]
            want |= {(token, salt, node, n) for token, salt in ordered[:p]}
    made = list(jaccard.prefix_rows(batches(texts, 50), np.packbits(flags).tobytes()))
    assert sum(b.num_rows for b in made) <= 16 * len(made) < len(want) / 10
    got = [r for b in made for r in zip(*(jaccard.numbers(b.column(c), k).tolist() for c, k in jaccard.PREFIX.items()))]
    assert len(got) == len(want) and set(got) == want
    # the rows of a token and salt are of one part
    part = {}
    for b in made:
        for row in b.slice(0, b.num_rows).to_pylist():
            for token, salt in zip(np.frombuffer(row["token"], np.int64).tolist(), np.frombuffer(row["salt"], np.int32).tolist()):
                assert part.setdefault((token, salt), row["deal"]) == row["deal"]
    # and all tokens of two nodes are told, frequent ones always
    shared = {t for b in jaccard.shared_rows(made) for t in zip(*(c.to_pylist() for c in b.columns))}
    nodes = {}
    for token, salt, node, _ in want:
        nodes.setdefault(token, set()).add(node)
    assert shared == {(token, node, n) for token, salt, node, n in want if salt or len(nodes[token]) > 1}


def test_sets_are_those_of_each_text():
    texts = corpus()
    for text, t in zip(texts, jaccard.token_sets(pa.array(texts, pa.string()))):
        words = (text or "").lower().split()
        k = min(5, len(words))
        assert len(t) == (len({tuple(words[i:i + k]) for i in range(len(words) - k + 1)}) if words else 0)
        assert (np.diff(t.astype(object)) > 0).all()


def test_blocks_reach_over_batches():
    rng = random.Random(4)
    v = vocabulary(5)
    base = prose(rng, 60, v)
    texts = [f"{base} {v[i]}" if i % 3 else prose(rng, 40, v) for i in range(60)]
    rows = pa.table({"block": pa.array(sorted(i // 20 for i in range(60)), pa.int64()), "node": pa.array(range(100, 160), pa.int64()), "text": texts})
    want = sorted(r for b in jaccard.forests(rows.to_batches()) for r in zip(*(c.to_pylist() for c in b.columns)))
    assert len(want) == sum(1 for i in range(60) if i % 3) - 3
    for size in (1, 7, 20, 33):
        got = [r for b in jaccard.forests(rows.to_batches(max_chunksize=size)) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == want
