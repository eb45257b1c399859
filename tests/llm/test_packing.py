import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from relyscope.llm import packing

from .helpers import docs, prose, vocabulary


def test_pieces_sequences_and_ids(spark):
    rng = random.Random(6)
    v = vocabulary(13)
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 40, 300, 900]), v), "en", "s") for i in range(120)]
    rows += [(500, None, None, None), (501, "", "en", "s"), (502, "é\x00 <|endoftext|> \U0001F600\r\n  x's 12", "en", "s"),
             (503, prose(rng, 9000, v), "en", "s"), (7, rows[7][1], "en", "s"), (504, "a" * 30_000, "en", "s")]
    path = packing.default_tokenizer()
    got = packing.pack(docs(spark, rows).withColumnRenamed("lang", "length"), path).collect()
    plain = Tokenizer.from_file(path)
    want = []
    for d, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (len(ids) <= 2048) == (len(packing.cuts(len(ids))) == 1)
        want += [(d, p, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cuts(len(ids)))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        ends = 0
        for offset, length in sorted(s):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(4097) == [(0, 1), (1, 2048), (2049, 2048)]


def test_plan_uses_every_piece_and_two_fit():
    rng = np.random.default_rng(1)
    for most, n in ((20, 50), (64, 3000)):
        count = np.bincount(rng.integers(1, most + 1, n), minlength=most + 1)
        used = np.zeros(most + 1, int)
        for times, lengths in packing.plan(count, most):
            assert sum(lengths) <= most
            for x in lengths:
                used[x] += times
        assert (used == count).all()
    # greedy fills 10 = 7 + 2; two-fit puts 3 in place of 2 with none left over: 7 + (1 + 2) does better
    assert sorted(packing.plan(np.bincount([7, 2, 1], minlength=11), 10)[0][1]) == [1, 2, 7]
    assert packing.two_fit([1, 2, 4], [0, 1, 1, 0, 1], 6, 4) == (4, 2)
    assert packing.two_fit([3], [0, 0, 0, 1], 6, 4) is None


def test_no_documents(spark):
    assert packing.pack(docs(spark, []), packing.default_tokenizer()).count() == 0
