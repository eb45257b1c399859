import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from relyscope.llm import infill

from .helpers import docs, prose, vocabulary

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(d, t):
    t = t or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def sample():
    rng = random.Random(13)
    v = vocabulary(4) + ["\U0001F600é", "x\x00y", "<S", "P>", "<", "<M", " ", "a\x1cb", "<M >"]
    blank = lambda: rng.choice([" ", "  ", "\n", " \t\r\n", "\x0b\x0c"])
    rows = [(i, rng.choice(["", " "]) + "".join(rng.choice(v) + blank() for _ in range(rng.choice([0, 1, 3, 30, 300]))), "en", "s") for i in range(300)]
    return rows + [(400, None, None, None), (401, "", "en", "s"), (402, " \n ", "en", "s"), (403, "one <P> two", "en", "s"), (404, "x <S>", "en", "s"),
                   (405, "a<M>", "en", "s"), (None, "some words here", "en", "s"), (7, rows[7][1], "en", "s"), (406, prose(rng, 60_000, v), "en", "s"),
                   (407, "天地玄黄宇宙洪荒", "zh", "s")]


def test_against_plain_python_and_round_trip(spark):
    rows = sample()
    table = docs(spark, rows).withColumnRenamed("lang", "output").withColumnRenamed("source", "form").withColumnRenamed("n_chars", "n")
    cut = infill.fill_in_middle(table)
    got = cut.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(((d, *brute(d, t)) for d, t, *_ in rows), key=repr)
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((d or -1, t or "") for d, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 64, 1000):
        widths = rng.integers(1, 9, n)
        units = infill.SkipList(widths)
        reached = np.concatenate([[0], np.cumsum(widths)])
        assert [units.code_points(r) for r in range(n + 1)] == reached.tolist()
    assert 4 <= len(units.lanes) <= 12  # a thousand units are reached by lanes, not one by one
    assert sum(len(w) for _, _, w in units.lanes[3:]) < 40


def test_other_rates_and_empty_table(spark):
    rows = sample()[:50]
    assert {r.form for r in infill.fill_in_middle(docs(spark, rows), fim_percent=0).collect()} == {"plain"}
    assert "psm" not in {r.form for r in infill.fill_in_middle(docs(spark, rows), fim_percent=100, spm_percent=100).collect()}
    assert infill.fill_in_middle(docs(spark, [])).collect() == []
