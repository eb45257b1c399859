import hashlib
import random
import zlib

import numpy as np
import pytest

from relyscope.llm import periodic, wordseq

from .helpers import docs, prose, vocabulary, words


def brute(w):
    """Every maximal stretch by trying all periods; each under its smallest one."""
    found = {}
    for q in range(1, len(w) // periodic.TIMES + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            if b + q - a >= max(periodic.LEAST, periodic.TIMES * q):
                found.setdefault((a, b + q - a), q)
            a = b + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng, n):
    """Words with stretches of many periods and depths."""
    w = []
    while len(w) < n:
        unit = [rng.choice("ab") if rng.random() < 0.6 else rng.choice(vocabulary(1, 30)) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
        stretch = unit * rng.randint(1, 6)
        w += stretch[:len(stretch) - rng.randint(0, len(unit) - 1)]
        w += [rng.choice(vocabulary(1, 30)) for _ in range(rng.randint(0, 4))]
    return w


def sample():
    rng = random.Random(11)
    rows = [(i, " ".join(repetitive(rng, rng.randint(1, 400))), "en", "s") for i in range(80)]
    rows += [(100, None, None, None), (101, "", "en", "s"), (102, " \n\t ", "en", "s"), (103, "a " * 24, "en", "s"), (104, "a " * 23, "en", "s"),
             (105, "a\x1fb  c\r\nd " * 9, "en", "s"), (106, "ein Wort\x85nur " * 12, "de", "s"), (None, "x y " * 30, "en", "s"), (3, rows[3][1], "en", "s"),
             (107, "a b " * 20 + "b c " * 20, "en", "s"), (108, prose(rng, 3000, vocabulary(2)) + " z" * 5000, "en", "s")]
    return rows


def test_against_all_periods(spark):
    rows = sample()
    table = docs(spark, rows).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    got = periodic.collapse_runs(table).collect()
    want = []
    for d, t, *_ in rows:
        runs = brute(words(t)) if d != 108 else [(3000, 5000, 1)]
        want.append((d, runs, collapsed(words(t), runs)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(len(r[1]) for r in want) > 100


def test_deep_periods_make_one_seed_each():
    word, _ = wordseq.word_hashes(__import__("pyarrow").array(["a " * 50_000]))
    got = list(periodic.seeds(word, np.zeros(len(word), np.int64)))
    # a gram that occurs everywhere pairs with its next occurrence only
    assert sum(len(at) for at, _ in got) < len(word)


def planted(d, w):
    h = zlib.crc32(str(d).encode())
    g = h // 10
    if d is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_query_digests(spark, tmp_path):
    rows = [(i, t, s, x) for i, (_, t, s, x) in enumerate(sample())] + [(None, "a " * 40, "en", "s")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for d, t, *_ in rows:
        w = planted(d, words(t))
        runs = brute(w) if len(w) < 3000 else [tuple(r) for r in next(
            x.runs for x in periodic.collapse_runs(docs(spark, [(0, " ".join(w), "", "")])).collect())]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        want.append((d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *(
            hashlib.sha256(x.encode()).hexdigest() for x in (told, collapsed(w, runs)))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(1 for d, *_ in rows if zlib.crc32(str(d).encode()) % 10 == 0) > 3


def test_empty_table(spark):
    assert periodic.collapse_runs(docs(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["", "a", " a", "a ", "é\x00 b\n\nc  ", "a b\x1cc d"])
def test_words_are_those_of_the_contract(text):
    import pyarrow as pa

    hashes, first = wordseq.word_hashes(pa.array([None, text, "a", text]))
    assert np.diff(first).tolist() == [0, len(words(text)), 1, len(words(text))]
    assert (hashes[first[1]:first[2]] == hashes[first[3]:first[4]]).all()
    assert [w.decode() for w in text.encode().split()] == words(text)
