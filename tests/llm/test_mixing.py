import random

from pyspark.sql import functions as F

from relyscope.llm import mixing

from .helpers import docs, prose, vocabulary, words


def targets(sizes):
    """Shares by weight, the excess over twice a source's size re-shared until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, got, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(got.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return got | share
        got |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return got


def sample():
    rng = random.Random(8)
    v = vocabulary(15)
    rows = []
    for i in range(700):
        source = rng.choice(["hot"] * 8 + ["a", "b", "ä", "Z", None, "tiny"])
        rows.append((i, prose(rng, int(rng.paretovariate(1.2) * 4), v), "en", source))
    return rows + [(1000, None, None, "a"), (1001, "", "en", "blank"), (1002, " ", "en", "blank"), (3, rows[3][1], "en", rows[3][3]),
                   (1003, prose(rng, 4000, v), "en", "hot"), (None, "null id", "en", "b")]


def test_targets_and_taken_words(spark):
    rows = sample()
    d = docs(spark, rows).withColumnRenamed("lang", "size")
    sized = mixing.stored(mixing.numbered(mixing.stored(mixing.sized(d, "doc_id"), "test")), "test")
    got = mixing.with_copies(sized, mixing.planned(sized)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == size and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert all(0 <= r.copies <= 2 for r in own)
        taken = sum(r.copies * r.size for r in own)
        biggest = max(r.size for r in own)
        assert abs(taken - want[s]) <= biggest + 1, (s, taken, want[s])
    again = mixing.with_copies(sized, mixing.planned(sized)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.key)
    assert [r.copies for r in sorted(got, key=key)] == [r.copies for r in sorted(again, key=key)]


def test_rates_meet_targets_before_rounding(spark):
    sized = mixing.stored(mixing.numbered(mixing.stored(mixing.sized(docs(spark, sample())), "test")), "test")
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    goal = mixing.tilts(sizes, mixing.targets(sizes))
    rate = mixing.rate(F.col("tilt"), F.col("size"), F.col("mean_size"))
    for r in mixing.rated(sized, goal).groupBy("of", "target").agg(F.sum(rate * F.col("size")).alias("got")).collect():
        assert abs(r.got - r.target) <= 1e-4 * max(1.0, r.target)


def test_mixed_rows_and_empty_table(spark):
    rows = sample()
    d = docs(spark, rows)
    mixed = mixing.mix_documents(d)
    assert mixed.columns == d.columns
    n = sum(len(words(t)) for _, t, *_ in rows)
    taken = sum(len(words(r.text)) for r in mixed.collect())
    assert abs(taken - 1.5 * n) < 0.05 * n
    assert mixing.mix_documents(docs(spark, [])).count() == 0


def test_equal_rows_move_one_by_one(spark):
    ten = "one two three four five six seven eight nine ten"
    other = [(i, ten, "en", "z") for i in range(100, 190)]
    rows = [(7, ten, "en", "a")] * 60 + other  # targets: by weight 3 to 1 of 2250, at most 1200 for a
    for got in (mixing.mix_documents(docs(spark, rows)).collect(), mixing.mix_documents(docs(spark, rows).repartition(5)).collect()):
        n = {s: sum(r.source == s for r in got) for s in "az"}
        want = targets({"a": 600, "z": 900})
        assert abs(10 * n["a"] - want["a"]) <= 10 and abs(10 * n["z"] - want["z"]) <= 10
    alone = [(7, ten, "en", "a")] * 60 + [(i, ten, "en", "z") for i in range(100, 440)]
    got = mixing.mix_documents(docs(spark, alone)).collect()
    assert sum(r.source == "a" for r in got) == 120  # at its cap


def test_ranks_of_equal_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 500 + list(range(2, 300)) + [5] * 40], "key long").repartition(7)
    got = {}
    for r in mixing.numbered(mixing.stored(rows, "keys")).collect():
        got.setdefault(r.key, []).append(r.rank)
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    assert len(got[1]) == 500 and len(got[5]) == 41


def test_any_column_names_pass_through(spark):
    rows = sample()[:60]
    names = {"lang": "key", "n_chars": "copies"}
    table = docs(spark, rows).withColumnsRenamed(names).selectExpr("*", "'x' as rank", "1.5 as size", "2 as `row`", "3 as of", "4 as `rows`", "'b' as part", "7 as again")
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns and mixed.dtypes == table.dtypes
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, table.collect()))
