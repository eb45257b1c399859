"""The pipeline's stages: names that clash, and the chain against plain forms."""

import pytest

import corpus_pipeline
from relyscope.llm import jaccard, linededup, mixing, quality

from .helpers import docs

CLASHING = ["score", "kept", "n_words", "_key", "_row_key", "_copies", "_copy", "_removed", "n_lines", "n_removed", "base_failed",
            "_h", "_b", "_llr", "_kept", "key", "row", "rank", "size", "of", "rows", "copies", "again", "part", "removed", "a.b", "root", "n_symbols"]


@pytest.mark.parametrize("stage", ["quality", "lines", "jaccard", "mixing"])
def test_clashing_columns_come_back_unchanged(spark, stage):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s") for i in range(20)] + [(50, None, None, None), (51, "", "en", "s")]
    table = docs(spark, rows).selectExpr("*", *[f"concat('{c}', coalesce(doc_id, 0)) as `{c}`" for c in CLASHING])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {"quality": lambda: quality.good_documents(table, labels), "lines": lambda: linededup.fresh_documents(table),
           "jaccard": lambda: jaccard.one_of_each(table), "mixing": lambda: mixing.mix_documents(table)}[stage]()
    assert got.columns == table.columns and got.dtypes == table.dtypes
    found = got.collect()
    assert found and set(found) <= set(table.collect())


def test_the_chain_loses_nothing(spark):
    """Every stage on its predecessor's rows, against what its plain form keeps of them."""
    from ..conftest import SMALL
    from .helpers import words

    table, rows = corpus_pipeline.read(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        rows[name + "_in"] = table.collect()
        table = corpus_pipeline.stored(stage(spark, table, SMALL), name)
        rows[name] = table.collect()
    good = {r.doc_id for r in rows["quality_rules"]}
    verdicts = quality.scored(corpus_pipeline.read(spark, SMALL, "documents").select("doc_id", "text"), corpus_pipeline.read(spark, SMALL, "labels")).collect()
    assert good == {r.doc_id for r in verdicts if r.kept}
    # line dedup: every line of a text that stays is one of the text before, in order
    before = {r.doc_id: r.text for r in rows["line_dedup_in"]}
    for r in rows["line_dedup"]:
        at = iter(before[r.doc_id].split("\n"))
        assert all(line in at for line in r.text.split("\n"))
    gone = set(before) - {r.doc_id for r in rows["line_dedup"]}
    kept_lines = {x for r in rows["line_dedup"] for x in r.text.split("\n")}
    assert all(words(before[d]) for d in gone)
    exact = [x for d in sorted(before) for x in before[d].split("\n") if words(x)]
    assert len(kept_lines) <= len(set(exact))
    # one document of each group: shingle sets that stay are not near each other
    sets = {r.doc_id: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for r in rows["jaccard_join"] if (w := words(r.text.lower()))}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            assert 100 * common < 75 * (len(sets[a]) + len(sets[b]) - common)
    # mixing: whole rows, up to twice; packing: each of them once
    mixed = [r.doc_id for r in rows["source_mix"]]
    assert set(mixed) <= {r.doc_id for r in rows["jaccard_join"]} and max(map(mixed.count, set(mixed))) <= 2
    pieces = [r.doc_id for r in rows["packing"] if r.piece == 0]
    assert sorted(pieces) == sorted(mixed)
    by_sequence = {}
    for r in rows["packing"]:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
