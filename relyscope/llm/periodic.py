"""Periodic runs of words: seed and extend on diagonals.

A run is a stretch of words with smallest period q and length of at least
max(``LEAST``, ``TIMES`` * q) that cannot be extended. On the diagonal of lag q (word
i against word i + q) a run is a stretch of length - q equal pairs, so at least
``SEED`` of them for the smallest lags and 2 * q beyond: the guaranteed overlap.

Seeds are grams of that length, k = 16, 32, 64, ...; a gram of length k finds the
lags up to k (over k / 2 beyond the first). Grams are named by doubling (a gram of 2k
is the pair of names of its halves), and only grams that occur again are carried on,
so most texts stop at the first lengths. A gram no shorter than the lag, inside a
run of smallest period q, next occurs exactly q words on; hence the pairs of
neighbouring occurrences hold a seed of every run, and no lag of a multiple of its
period: pairs are as many as words, however often a gram repeats. Seeds are
extended in order; a table of the furthest word covered on each lag skips
those inside a stretch that is known.

Defined results: null and empty texts have no runs and an empty collapsed text; rows
are independent (repeated rows, equal or null ids change nothing); a text of
any length is looked at as a whole, in memory in proportion to it; an empty table
gives an empty result; columns other than doc_id and text play no part and are not
returned, so no name can clash. Of runs of equal length / period the first is the
one of smallest start, then period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read, words
from .wordseq import pieces, word_hashes

by_value(__name__)

LEAST, TIMES = 24, 3
SEED = 16  # equal pairs on the diagonal that every run has at least


def named(values: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose value occurs again, names over all n positions, -1 for others)."""
    _, name, count = np.unique(values, return_inverse=True, return_counts=True)
    again = count[name] > 1
    names = np.full(n, -1, np.int64)
    names[at[again]] = name[again]
    return at[again], names


def seeds(word: np.ndarray, doc: np.ndarray):
    """(position, lag) pairs of neighbouring occurrences of equal grams within a text."""
    n = len(word)
    # equal words of different texts get different names
    at, names = named(word ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.arange(n), n)
    k = 1
    while len(at):
        if k >= SEED:
            order = at[np.argsort(names[at], kind="stable")]
            lag = np.diff(order)
            lag[names[order[1:]] != names[order[:-1]]] = 0
            fits = (lag <= k) & (lag > (k // 2 if k > SEED else 0))
            yield order[:-1][fits], lag[fits]
        at = at[at + k < n]
        at = at[(names[at + k] >= 0) & (doc[at] == doc[at + k])]
        at, names = named(names[at] * n + names[at + k], at, n)
        k *= 2


def same(a: np.ndarray, b: np.ndarray) -> int:
    """How many first items are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        unlike = np.flatnonzero(a[at:min(n, at + step)] != b[at:min(n, at + step)])
        if len(unlike):
            return at + int(unlike[0])
        at, step = at + step, step * 2
    return n


def found_runs(word: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start, then period."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    got = [x for x in seeds(word, doc)]
    if not got:
        return runs
    at, lag = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((at, lag, doc[at]))
    at, lag = at[order], lag[order]
    fresh = np.ones(len(at), bool)  # the others lie right behind another seed of their lag
    fresh[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
    covered: dict[tuple[int, int], int] = {}  # furthest word covered, by text and lag
    for i, q in zip(at[fresh].tolist(), lag[fresh].tolist()):
        d = int(doc[i])
        if i < covered.get((d, q), -1):
            continue
        lo, hi = int(first[d]), int(first[d + 1])
        a = i - same(word[lo:i][::-1], word[lo + q:i + q][::-1])
        b = i + same(word[i:hi - q], word[i + q:hi])
        covered[d, q] = b
        if b + q - a >= max(LEAST, TIMES * q):
            runs[d].append((a - lo, b + q - a, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def kept(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run drops (all but its first period), joined by blanks."""
    own = text.split()  # of bytes: at ASCII white space
    if runs:
        stays = np.ones(len(own), bool)
        for start, length, period in runs:
            stays[start + period:start + length] = False
        own = [own[i] for i in np.flatnonzero(stays).tolist()]
    return b" ".join(own)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapsed(batches):
    for b in pieces(batches, "text"):
        word, first = word_hashes(b.column("text"))
        runs = found_runs(word, first)
        texts = b.column("text").cast(pa.binary()).to_pylist()
        short = pa.array([kept(t or b"", r) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        told = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], pa.list_(RUN))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), told, short], ["doc_id", "runs", "collapsed"])


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs`` (doc_id, text): its runs by
    start, then period, and its words without those that repeat a run's first period."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(collapsed, f"doc_id {kind}, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The query's input: of every tenth document (by crc32 of its id) the words from
    some word on repeat a stretch of them. Null ids are left alone."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    n = F.size("w")
    a = F.col("g") % n
    staged = chosen.where("w is null or size(w) = 0").select("doc_id", "text").union(
        chosen.where("size(w) > 0").select("doc_id", "w", n.alias("n"), a.cast("int").alias("a"), (
            1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int").alias("p")).select("doc_id", F.array_join(F.transform(
                F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(
                    F.col("a") + (i - F.col("a")) % F.col("p")))), " ").alias("text")))
    return staged


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(planted(read(spark, sf_dir, "documents")))
    # the greatest length / period; ties to the smaller start, then period (negated: max)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("best.length * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: Equal 16-grams of a text, islands of them on a lag; of equal stretches the smallest period.
OP11_SQL = r"""
WITH crc_table AS (  -- crc32 by bytes: its table, then the digits of doc_id
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc_of),
crcs AS (
  SELECT doc_id, text, row_number() OVER () AS row, xor(list_reduce(list_prepend(4294967295, list_transform(
    string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, x: xor(c // 256, crc_of[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM documents, crc_table),
hashed AS (
  SELECT doc_id, row, h, h // 10 AS g,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS own
  FROM crcs),
planned AS (
  SELECT *, g % len(own) AS a, 1 + (len(own) - g % len(own)) // (3 + g % 8) AS p FROM hashed),
docs AS (
  SELECT doc_id, row, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN list_transform(range(0, len(own)),
    lambda i: own[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) ELSE own END AS w
  FROM planned),
grams AS (
  SELECT row, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS gram
  FROM (SELECT row, w, unnest(range(0, len(w) - 15)) AS i FROM docs WHERE len(w) >= 24)),
pairs AS (
  SELECT x.row, x.i, y.i - x.i AS q
  FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND y.i > x.i),
islands AS (
  SELECT row, q, min(i) AS start, count(*) + 15 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs)
  GROUP BY row, q, island),
runs AS (
  SELECT row, start, length, min(q) AS period FROM islands
  WHERE length >= greatest(24, 3 * q) GROUP BY row, start, length),
listed AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY row),
best AS (
  SELECT row, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs) ANTI JOIN gone USING (row, i)
  GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (row) LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
"""
