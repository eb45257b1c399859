import hashlib
import random

import pytest

from relyscope.llm import substrings

from .helpers import docs, prose, vocabulary, words


def brute(rows):
    """(doc_id, words, removed, kept) by a table of all windows."""
    least = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            x = tuple(w[i:i + 50])
            if d is not None and d < least.get(x, d + 1):
                least[x] = d
    out = []
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def sample(n=120):
    rng = random.Random(12)
    v = vocabulary(6)
    passages = [prose(rng, m, v) for m in (30, 49, 50, 51, 70, 200, 800)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 60), v)]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(passages).split()
            a = rng.randint(0, len(w) // 3) if rng.random() < 0.5 else 0
            w = w[a:len(w) - (rng.randint(0, len(w) // 3) if rng.random() < 0.5 else 0)]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "changed"
            parts += [" ".join(w), prose(rng, rng.randint(0, 30), v)]
        rows.append((rng.randint(0, 10_000), rng.choice([" ", "\n", "  \t"]).join(parts), "en", "s"))
    rows += [(i, rows[5][1], "en", "s") for i in (20_001, 20_002, 3)]  # copies
    rows += [(20_010, None, None, None), (20_011, "", "en", "s"), (20_012, "\n \t", "en", "s"), (None, passages[5], "en", "s"), (None, passages[5], "en", "s"),
             (20_013, passages[6], "en", "s"), (20_013, passages[6], "en", "s"), (20_013, passages[6] + " more", "en", "s"),
             (20_014, "one " * 500, "en", "s"), (20_015, "one " * 60, "en", "s"), (20_016, prose(rng, 20_000, v) + " " + passages[4], "en", "s")]
    return rows


def found(spark, rows):
    table = docs(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "spans").withColumnRenamed("n_chars", "context")
    return sorted(map(tuple, substrings.remove_repeats(table).collect()), key=repr)


def test_against_a_table_of_all_windows(spark):
    rows = sample()
    want = brute(rows)
    assert sum(1 for _, n, gone, _ in want if 0 < gone < n) > 20
    assert found(spark, rows) == want


@pytest.mark.parametrize("spread, shard", [(1, 20_000), (3, 200), (10**6, 1)])
def test_hot_anchors_and_small_shards(spark, monkeypatch, spread, shard):
    monkeypatch.setattr(substrings, "SPREAD", spread)
    monkeypatch.setattr(substrings, "SHARD", shard)
    rng = random.Random(5)
    v = vocabulary(9)
    common = prose(rng, 25, v)  # shared by all, too short to go on its own
    rows = [(i, f"{prose(rng, 40, v)} {common} {prose(rng, 40, v)}", "en", "s") for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n") + " tail", "en", "s") for i in range(0, 40, 2)]
    rows += [(200 + i, " ".join(rows[i][1].split()[10:80]), "en", "s") for i in range(0, 40, 3)]
    want = brute(rows)
    assert sum(gone > 0 for _, _, gone, _ in want) >= 34
    assert found(spark, rows) == want


def test_automaton_against_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [([rng.randrange(3) for _ in range(rng.randint(0, 25))], rng.randint(0, 6)) for _ in range(6)]
        built = substrings.Automaton()
        for words_, doc in sequences:
            built.add(words_, doc)
        built.settle()
        for words_, doc in sequences + [([rng.randrange(4) for _ in range(20)], 3)]:
            want = [i for i in range(len(words_) - 4) if any(
                d < doc and w[j:j + 5] == words_[i:i + 5] for w, d in sequences for j in range(len(w) - 4))]
            assert built.earlier(words_, doc, 5) == want


def test_query_digests(spark, tmp_path):
    rows = sample(30)
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, substrings.op12_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows)), key=repr)


def test_empty_table(spark):
    assert substrings.remove_repeats(docs(spark, [])).collect() == []
