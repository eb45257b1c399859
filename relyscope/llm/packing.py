"""Best-two-fit packing of token sequences.

Documents are tokenized where they lie; only lengths matter for packing, and a
sequence holds at most ``SEQUENCE`` tokens, so the whole corpus is planned from
one count a length, at most ``SEQUENCE`` numbers at any corpus size. The plan is
a list of patterns (lengths that share a sequence) with their repetitions. A
pattern is filled greedily, largest fitting length first; then its smallest
document gives way to the two unpacked ones that fill the expanded gap best, if
they fill more than it did. Pieces get gapless numbers per length, and a
piece's number decides its pattern, sequence and offset.

Defined results: null and empty texts are the closing id alone (length 1);
repeated rows are packed like any other; empty tables give an empty result. Long
texts are cut into full pieces after a first piece that holds the remainder.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read, stored
from .ranks import numbered

by_value(__name__)

SEQUENCE = 2048
CLOSING_ID = 0
# Fixed value: the word-splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """The ids of a text by a tokenizers file, whose ids are its merge ranks. Added
    tokens' strings in the text become their ids, and what lies between them is encoded
    on its own, as ``tokenizers`` does with ``add_special_tokens=False``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    symbols = byte_symbols()
    ranks = {bytes(symbols[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    ordinary = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return ordinary
    split = re.compile("(" + "|".join(re.escape(s) for s in sorted(added, key=len, reverse=True)) + ")").split

    def encode(text: str) -> list[int]:
        first, *rest = split(text)
        ids = ordinary(first)
        for token, after in zip(rest[::2], rest[1::2]):
            ids += [added[token], *ordinary(after)]
        return ids

    return encode


def cuts(n: int, most: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n % most or most
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(batches, path: str):
    encode = encoder(path)
    for batch in batches:
        out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for row, text in enumerate(batch.column("text")):
            ids = np.array([*encode(text.as_py() or ""), CLOSING_ID], "<u4").tobytes()
            for piece, (start, length) in enumerate(cuts(len(ids) // 4)):
                for name, value in zip(out, (row, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()),
             *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]],
            ["doc_id", "piece", "start", "length", "ids_crc32"])


def two_fit(lengths: list[int], count: list[int], gap: int, more_than: int) -> tuple[int, int] | None:
    """The two free lengths of largest sum in (more_than, gap]. ``lengths`` ascends."""
    best, low, high = None, 0, len(lengths) - 1
    while low <= high:
        if low == high and count[lengths[low]] < 2:
            break
        both = lengths[low] + lengths[high]
        if both > gap:
            high -= 1
        else:
            if both > more_than:
                more_than, best = both, (lengths[high], lengths[low])
            low += 1
    return best


def plan(count: np.ndarray, most: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Patterns as (repetitions, lengths), from ``count[length]``."""
    count = [int(c) for c in count]
    patterns = []
    if count[most]:
        patterns.append((count[most], [most]))
        count[most] = 0
    lengths = [n for n in range(1, most) if count[n]]
    while lengths:
        used, gap = [], most
        while (i := bisect_right(lengths, gap)):
            n = lengths[i - 1]
            used.append(n)
            gap -= n
            count[n] -= 1
            if not count[n]:
                lengths.pop(i - 1)
        if gap and lengths:
            smallest = used[-1]
            if pair := two_fit(lengths, count, gap + smallest, smallest):
                used[-1:] = pair
                if not count[smallest]:
                    lengths.insert(bisect_right(lengths, smallest), smallest)
                count[smallest] += 1
                for n in pair:
                    count[n] -= 1
        uses = {n: used.count(n) for n in used}
        again = min(count[n] // c for n, c in uses.items())
        for n, c in uses.items():
            count[n] -= again * c
        lengths = [n for n in lengths if count[n]]
        patterns.append((1 + again, sorted(used, reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Ranges of piece numbers by length: where each range's sequences begin, how
    many of that length a sequence takes, and their offset in it."""
    taken, rows, sequence = {}, [], 0
    for times, used in patterns:
        offset = 0
        for n in dict.fromkeys(used):
            c = used.count(n)
            rows.append((n, taken.get(n, 0), sequence, c, offset))
            taken[n] = taken.get(n, 0) + c * times
            offset += c * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "sequence", "each", "offset"), table.T))


def placed(batches, table: dict[str, np.ndarray]):
    key = (table["length"] << 48) + table["low"]
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
        k, each = rank - table["low"][at], table["each"][at]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
             pa.array(table["sequence"][at] + k // each), pa.array(table["offset"][at] + k % each * length)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer``: path of a byte-level tokenizers file, present on the executors.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = docs.select("doc_id", "text").mapInArrow(lambda it: pieces(it, tokenizer), schema)
    ranked = stored(numbered(cut, "length", "rank"), "pieces")
    count = np.zeros(SEQUENCE + 1, np.int64)
    for n, c in ranked.groupBy("length").count().collect():  # at most SEQUENCE rows
        count[n] = c
    table = slots(plan(count))
    return ranked.mapInArrow(lambda it: placed(it, table), f"{schema}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
