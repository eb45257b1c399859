import random

from relyscope.llm import language
from relyscope.llm.common import HELD_OUT_FOLD

from .helpers import docs, prose, vocabulary


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(2)
    langs = {"aa": vocabulary(3, 300, "etaoinshr"), "bb": vocabulary(4, 300, "oukázelmn"), "cc": vocabulary(5, 300, "жшеирта")}
    rows = [(i, prose(rng, rng.randint(1, 60), v), lang, "s") for i, (lang, v) in enumerate(list(langs.items()) * 60)]
    odd = [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !! \n", "aa", "s"), (1003, "\U0001F600", None, None),
           (None, rows[0][1], "aa", "s"), (5, rows[5][1], "cc", "s"), (1004, rows[1][1] * 3000, None, "s")]
    d = docs(spark, rows + odd).withColumnRenamed("n_chars", "score_")
    got = language.identify(d.select("doc_id", "text", "lang"), language.learn(d)).collect()
    assert len(got) == len(rows + odd)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002, 1003))
    named = [r for r in got if r.doc_id is not None and r.doc_id < 180]
    assert sum(r.lang == r.lang_pred for r in named) > 0.97 * len(named)
    assert all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id == 1004).lang_pred == "bb"


def test_out_of_place_distance():
    model = language.Identifier({"x": language.ranked(*language.ngrams(language.points_of("aab aab")), language.PROFILE),
                                 "y": language.ranked(*language.ngrams(language.points_of("ccd ccd")), language.PROFILE)})
    assert model("aab")[0] == "x" and model("ccd")[0] == "y"
    assert model("aab aab")[1] > 0.99


def test_nothing_to_learn_from(spark):
    empty = docs(spark, [])
    assert language.learn(empty) == {}
    got = language.identify(docs(spark, [(1, "some text", None, None)]).select("doc_id", "text"), {}).first()
    assert (got.lang_pred, got.score) == ("und", 0)
    assert language.identify(empty.select("doc_id", "text"), {}).count() == 0
    assert HELD_OUT_FOLD == 2


def brute(train, text):
    """Rank-order profiles with plain dictionaries: the nearest language, or und."""
    from collections import Counter

    def grams(t):
        w = " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
        out = Counter()
        if w.strip():
            for n in (1, 2, 3):
                out.update(w[i:i + n] for i in range(len(w) - n + 1))
            out.pop(" ", None)
        return out

    code = lambda g: tuple([0] * (3 - len(g)) + [ord(c) for c in g])
    order = lambda c, most: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:most]]
    profile = {}
    for t, lang in train:
        profile.setdefault(lang, Counter()).update(grams(t))
    profile = {k: {g: r for r, g in enumerate(order(c, language.PROFILE))} for k, c in profile.items()}
    own = order(grams(text), language.TOP)
    if not own or not profile:
        return "und"
    far = {k: sum(min(abs(p[g] - r), language.PROFILE) if g in p else language.PROFILE for r, g in enumerate(own)) for k, p in profile.items()}
    return min(sorted(far), key=far.get)


def test_query_against_plain_python(spark):
    import zlib

    import pyarrow.parquet as pq

    from ..conftest import SMALL

    table = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    train = [(r["text"], r["lang"]) for r in table if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    assert len(train) < language.TRAIN_ROWS  # no sample is drawn of so few
    some = [r for r in table if r["text"] and len(r["text"]) < 3000][:60]
    got = {r.doc_id: r for r in language.op2_language_id(spark, SMALL).collect()}
    assert len(got) == len(table)
    for r in some:
        assert got[r["doc_id"]].lang_pred == brute(train, r["text"]), r["doc_id"]
    assert all(got[r["doc_id"]].held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in table)
