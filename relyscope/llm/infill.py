"""Fill-in-middle transformation by an indexable skip list.

A text's units (a word with the white space before it, or white space at the end)
are the nodes of a skip list. Every link of every lane carries two widths: how
many units and how many code points it passes. To find the place of a cut, a walk
starts in the sparsest lane, takes each link whose units still fit, adds its code
points, and goes a lane down where none fits; the bottom lane has a link a unit, so
the wanted rank is reached exactly. Heights come from a hash of the unit's number:
a fourth of a lane's nodes are in the next one.

Cuts, form and marks follow from ``seed``, the doc_id and the text alone, so every
run and every order of rows gives the same result.

Defined results: null texts count as empty and stay plain; a null doc_id has the
empty string for its decimal; texts with a mark in them stay plain; equal cuts
(ties) make an empty middle; repeated rows give equal rows; a text of any length is
handled as a whole; an empty table gives an empty result; columns other than doc_id and
text play no part and are not returned, so no name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read
from .wordseq import mixed, pieces

by_value(__name__)

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
FEWER = 4  # nodes of a lane for one of the next


class SkipList:
    """Widths of units, to be found by rank."""

    def __init__(self, widths: np.ndarray):
        self.size = n = len(widths)
        reached = np.concatenate([[0], np.cumsum(widths)])  # code points before each unit, and in all
        draw = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        at, lane = np.arange(n + 1), 0  # nodes of a lane: before unit 0, 1, ... and the end
        while True:
            # (a node's place in the lane below, units and code points of its link)
            below = at if not lane else np.searchsorted(last, at)  # noqa: F821
            self.lanes.append((below.tolist(), np.diff(at).tolist(), np.diff(reached[at]).tolist()))
            lane, last = lane + 1, at
            # the head and the end are in every lane
            tall = (draw[at[1:-1] - 1] >> np.uint64(2 * lane)) % np.uint64(FEWER) == 0
            if len(at) <= 2 or not tall.any():
                break
            at = np.concatenate([at[:1], at[1:-1][tall], at[-1:]])

    def code_points(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        node = units = points = 0
        for below, unit_width, width in reversed(self.lanes):
            while node < len(width) and units + unit_width[node] <= rank:
                units += unit_width[node]
                points += width[node]
                node += 1
            node = below[node]
        return points


def units_of(text: str) -> np.ndarray:
    """Widths in code points of a text's units."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    black = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    # a unit ends with a word, or with the text
    ends = np.flatnonzero(black & np.concatenate([~black[1:], [True]])) + 1
    if len(codes) and not black[-1]:
        ends = np.append(ends, len(codes))
    return np.diff(ends, prepend=0)


def infilled(text: str, doc_id, seed: int, fim_percent: int, spm_percent: int):
    """(units, form, code points of prefix, of middle, output)."""
    widths = units_of(text)
    n = len(widths)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = sorted(units.code_points(h % (n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs``
    (doc_id, text)."""
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches):
        for b in pieces(batches, "text"):
            rows = [infilled(t or "", d, seed, fim_percent, spm_percent) for d, t in zip(
                b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*rows), kinds)]], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no mark, so the first of
    each mark is the one that was put in."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    between = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.split_part(rest, between, F.lit(1))
    tail = F.substr(rest, F.length(one) + len(PREFIX) + 1)
    two = F.split_part(tail, F.lit(MIDDLE), F.lit(1))
    middle = F.substr(tail, F.length(two) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50
              THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(units[greatest(x, y) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
