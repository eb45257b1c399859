"""Ids equal those of an unmodified Tokenizer where texts hold added tokens' strings."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from relyscope.llm import packing

from .helpers import docs

TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b", "x \n<|endoftext|>\n y's <|endoftext",
         "<|ENDOFTEXT|> <|endoftext|>" * 900, "plain", ""]


def test_added_tokens_become_their_ids(spark):
    path = packing.default_tokenizer()
    plain, encode = Tokenizer.from_file(path), packing.encoder(path)
    assert encode(TEXTS[0]) == [31373, 220, 50256, 995]
    want = []
    for i, t in enumerate(TEXTS):
        ids = plain.encode(t, add_special_tokens=False).ids
        assert encode(t) == ids
        ids = [*ids, packing.CLOSING_ID]
        want += [(i, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for s, n in packing.cuts(len(ids))]
    got = packing.pack(docs(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)]), path).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
