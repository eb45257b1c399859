import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relyscope.llm import common, jaccard, linededup, toxicity

from .test_jaccard import shingles


def test_workers_get_small_batches(spark):
    """Long texts come in several batches, however few rows they are, also in later results."""
    spark.conf.unset(common.BATCH_BYTES)
    rows = common.stored(spark.range(40).select("id", F.repeat(F.lit("word "), 100_000).alias("text")).coalesce(1), "long")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    got = rows.coalesce(1).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 40 and max(r.bytes for r in got) <= common.BATCH + 600_000


def test_ids_are_not_widened():
    ids = toxicity.id_rows(pa.array([[1, 2, 3], [], [4, 5, 6, 7, 8, 9]], pa.list_(pa.int32())))
    assert [len(x) for x in ids] == [1, 0, 2] and {x.dtype for x in ids} == {np.dtype(np.int32)}


def test_token_sets():
    """Words of whole texts, A-Z alone lower-cased; texts over a piece's bytes, nulls between them."""
    texts = ["A b C d E f", None, "a B c D e F", "", "É é É é É é", " \x0b", "x", "a b\tc\nd  e f " * 100_000, "b c d e f a b c d e"]
    sets = jaccard.token_sets(pa.array(["cut off", *texts]).slice(1))
    assert [len(t) for t in sets] == [len(shingles(t)) for t in texts]
    assert sets[0].tolist() == sets[2].tolist() and not set(sets[0].tolist()) & set(sets[4].tolist())
    assert set(sets[8].tolist()) <= set(sets[7].tolist())


def test_counts_of_lines_are_small_and_the_same():
    """Lines are counted some MB at a time; how many at once changes no count."""
    assert linededup.BLOCK * linededup.CLASSES * 8 <= 16 << 20
    codes = linededup.plain(["ab cd ef gh %d" % i + " x" * (i % 7) for i in range(2_500)], linededup.character_table(linededup.small_letters()))
    starts, ends = linededup.bounds(codes)
    parts = [linededup.counted(stretch, lines, 4)[own] for _, stretch, lines, own in linededup.blocks(codes, starts, ends)]
    assert len(parts) > 1 and (np.concatenate(parts) == linededup.counted(codes, len(starts), 4)).all()
