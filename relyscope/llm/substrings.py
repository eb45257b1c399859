"""Substring deduplication by suffix automata of reference shards.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document
of smaller id. Windows are judged on the input.

1. Anchors. Of the 20-word grams inside a window the one of least hash (the
   first of equal ones) is its anchor; equal windows have equal anchors at equal
   places. Neighbouring windows of one anchor form a context: the words from the
   first window's start to the last one's end, under a hash of its content.
2. Contexts of anchors that only one document has are dropped. Of equal contexts the
   smallest document alone is looked at further: in the others, all windows of the
   context go.
3. Shards. The different contexts of an anchor meet in one reference shard of about
   ``SHARD`` words. Of a shard one suffix automaton is built, each state with the
   smallest document in which its sequences occur. The contexts are then streamed
   through it: their matching statistics, cut at ``WINDOW`` words, give each
   window's state, and a window goes if that state's document is smaller.
4. Anchors of over ``SPREAD`` different contexts would make a shard too large: the
   windows of their contexts get anchors of more words, and steps 2 and 3 follow for
   these (``GRAMS``). The last anchor is the whole window, of which there is one content
   only. Nothing is dropped.

So automata travel to the contexts that can match them, not to all documents: what
repeats grows with the corpus, and no part of it is small enough to be sent
everywhere. Every join may be split by Spark where a key is hot.

Words are told apart by 64-bit hashes (``wordseq``), contexts and anchors too: among m
different ones about m^2 / 3.7e19 pairs share one (a billion: 0.03).

Defined results: null and empty texts, and texts of under ``WINDOW`` words, keep
all words (kept: joined by one blank; never null); rows without doc_id keep all and
are no reference; rows of equal doc_id are no reference for each other; equal rows are
treated alike; texts of any length are handled as a whole; an empty table gives an
empty result; columns other than doc_id and text play no part and are not
returned, so no name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read, stored
from .wordseq import mixed, pieces, stretches, word_hashes

by_value(__name__)

WINDOW = 50
GRAMS = (20, 35, WINDOW)  # words of an anchor, and of those that share hot anchors out
SHARD = 20_000  # words of a shard, about
SPREAD = 256  # contexts of an anchor in a shard at most


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` items where its first least one lies."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at


def contexts_of(word: np.ndarray, first: np.ndarray, gram: int):
    """(text, anchor, context, start, windows) of the contexts of texts' words."""
    if len(word) < WINDOW:
        return None
    content = stretches(word)
    grams = np.arange(len(word) - gram + 1)
    h = content(grams, grams + gram)
    at = leftmost_least(h, WINDOW - gram + 1)  # of the window that starts at each word
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + WINDOW <= first[text + 1])
    if not len(inside):
        return None
    new = np.ones(len(inside), bool)
    new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])
    start = inside[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(inside)))
    context = mixed(content(start, start + windows + WINDOW - 1) ^ windows.astype(np.uint64))
    return text[start], h[at[start]], context, start - first[text[start]], windows


def context_rows(b: pa.RecordBatch, word: np.ndarray, first: np.ndarray, gram: int):
    """The contexts of a batch's rows (doc_id, key), if any, as a batch."""
    if (got := contexts_of(word, first, gram)) is not None:
        text, anchor, context, start, windows = got
        rows = b.select(["doc_id", "key"]).take(pa.array(text))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(start.astype(np.int32)),
             pa.array(windows.astype(np.int32))], ["doc_id", "key", "anchor", "context", "start", "windows"])


def anchored(batches):
    for b in pieces(batches, "text"):
        yield from context_rows(b, *word_hashes(b.column("text")), GRAMS[0])


def anchored_again(batches, gram: int):
    """``anchored`` for contexts whose words are at hand."""
    for b in batches:
        column = b.column("words")
        first = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        yield from context_rows(b, column.flatten().to_numpy().view(np.uint64), first, gram)


class Automaton:
    """Suffix automaton of many sequences; of each state the smallest document."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [None]

    def state(self, size: int, follows: dict[int, int], link: int) -> int:
        self.next.append(follows)
        self.size.append(size)
        self.link.append(link)
        self.least.append(None)
        return len(self.size) - 1

    def target(self, p: int, word: int) -> int:
        """The state behind p's ``word``, split off if it also holds longer sequences."""
        q = self.next[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        own = self.state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def add(self, words: list[int], doc) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self.target(last, word)
            else:
                new = self.state(self.size[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self.target(p, word)
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def settle(self) -> None:
        """Hand the smallest documents down the links; call it after the last ``add``."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if self.least[p] is None or self.least[v] < self.least[p]:
                self.least[p] = self.least[v]

    def earlier(self, words: list[int], doc, window: int) -> list[int]:
        """Starts of the windows of ``words`` that also lie in a smaller document."""
        found, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if word not in self.next[state]:
                continue
            state, matched = self.next[state][word], matched + 1
            if matched >= window:
                while self.size[self.link[state]] >= window:  # the state that holds the window itself
                    state = self.link[state]
                matched = window
                if self.least[state] < doc:
                    found.append(i - window + 1)
        return found


def fetched(batches):
    """(anchor, context, doc_id, hot, words) of the contexts asked of each text."""
    for b in pieces(batches, "text"):
        word, first = word_hashes(b.column("text"))
        word, asked = word.view(np.int64), b.column("asked").to_pylist()
        rows = [(a["anchor"], a["context"], i, a["hot"], word[first[i] + a["start"]:first[i] + a["start"] + a["windows"] + WINDOW - 1])
                for i, own in enumerate(asked) for a in own]
        if rows:
            anchor, context, i, hot, words = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(context), b.column("doc_id").take(pa.array(i)), pa.array(hot), pa.array(words, pa.list_(pa.int64()))],
                ["anchor", "context", "doc_id", "hot", "words"])


def judged(batches):
    """(context, earlier): the starts of its windows that a smaller document has too."""
    rows = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("anchor", "context", "doc_id")], b.column("words"))]
    rows.sort(key=lambda r: r[:2])
    at = 0
    while at < len(rows):
        end, size = at, 0
        # whole anchors
        while end < len(rows) and (size < SHARD or rows[end][0] == rows[end - 1][0]):
            size += len(rows[end][3])
            end += 1
        shard = Automaton()
        contexts = [(context, doc, words.as_py()) for _, context, doc, words in rows[at:end]]
        for _, doc, words in contexts:
            shard.add(words, doc)
        shard.settle()
        found = [(context, starts) for context, doc, words in contexts if (starts := shard.earlier(words, doc, WINDOW))]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int32()))], ["context", "earlier"])
        at = end


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


CONTEXT = "key long, anchor long, context long, start int, windows int"


def repeated_windows(every: DataFrame, fetch, level: int = 0) -> DataFrame:
    """``key, spans`` of what holds windows that a smaller document has too; spans: (first
    window's start, windows). ``every``: contexts (doc_id, key, ...) by anchors of
    ``GRAMS[level]`` words; ``fetch`` gives the words of contexts asked by key."""
    kind = every.schema["doc_id"].dataType.simpleString()
    several = stored(every.groupBy(F.col("anchor").alias("of")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(
        "lo < hi").select("of"), "several")
    shared = stored(every.join(several, F.col("anchor") == F.col("of")).drop("of"), "shared")
    distinct = stored(shared.groupBy("anchor", "context").agg(F.min(F.struct("doc_id", "key", "start", "windows")).alias("least")), "distinct")
    counts = stored(distinct.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    asked = distinct.join(counts, F.col("anchor") == F.col("of")).groupBy(F.col("least.key").alias("k")).agg(F.collect_list(F.struct(
        "anchor", "context", (F.col("n") > SPREAD).alias("hot"), F.col("least.start").alias("start"), F.col("least.windows").alias("windows"))).alias("asked"))
    contexts = stored(fetch(asked), "references")
    judgement = contexts.where("not hot").repartition("anchor").mapInArrow(judged, "context long, earlier array<int>")
    if level + 1 < len(GRAMS) and not counts.where(F.col("n") > SPREAD).isEmpty():
        hot = contexts.where("hot").withColumnRenamed("context", "key")
        parts = stored(hot.mapInArrow(lambda it: anchored_again(it, GRAMS[level + 1]), f"doc_id {kind}, {CONTEXT}"), "contexts")
        cut = F.transform("asked", lambda a: F.struct(a["anchor"].alias("anchor"), a["context"].alias("context"), a["hot"].alias("hot"), F.slice(
            "words", a["start"] + 1, a["windows"] + (WINDOW - 1)).alias("words")))
        found = repeated_windows(parts, lambda asked: hot.join(asked, F.col("key") == F.col("k")).select("doc_id", F.inline(cut)).select(
            "anchor", "context", "doc_id", "hot", "words"), level + 1)
        judgement = judgement.union(found.select("key", F.flatten(F.transform("spans", lambda s: F.sequence(
            s["start"], s["start"] + s["windows"] - 1)))))
    # equal rows of the input give the same judgement of a context
    known = stored(judgement, "judged").groupBy(F.col("context").alias("c")).agg(F.first("earlier").alias("earlier"))
    verdict = stored(distinct.select(F.col("context").alias("of"), F.col("least.doc_id").alias("least")).join(
        known, F.col("of") == F.col("c"), "left").select("of", "least", "earlier"), "verdicts")
    spans = shared.join(verdict, F.col("context") == F.col("of")).select(
        "key", F.when(F.col("doc_id") > F.col("least"), F.array(F.struct("start", "windows"))).otherwise(F.transform(
            "earlier", lambda s: F.struct((F.col("start") + s).alias("start"), F.lit(1).alias("windows")))).alias("own")).where("own is not null")
    return spans.distinct().groupBy("key").agg(F.flatten(F.collect_list("own")).alias("spans"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """``repeated_windows`` of documents, by xxhash64 of doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = keyed(docs).where("doc_id is not null and text is not null")
    every = stored(texts.mapInArrow(anchored, f"doc_id {kind}, {CONTEXT}"), "contexts")
    return repeated_windows(every, lambda asked: texts.join(asked.hint("merge"), F.col("key") == F.col("k")).select(
        "doc_id", "text", "asked").mapInArrow(fetched, f"anchor long, context long, doc_id {kind}, hot boolean, words array<long>"))


def without(batches):
    """(doc_id, n_words, n_removed, kept) of every text."""
    for b in pieces(batches, "text"):
        rows = []
        for text, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans")):
            own = (text or b"").split()  # of bytes: at ASCII white space
            n, spans = len(own), spans.values if spans.is_valid else None
            if spans is not None:
                start, windows = (spans.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                gone = np.zeros(n + 1, np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + windows + WINDOW - 1, -1)
                own = [own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            rows.append((n, n - len(own), b" ".join(own)))
        n, removed, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = removed_spans(docs).select(F.col("key").alias("k"), "spans")
    marked = keyed(docs).join(spans.hint("merge"), F.col("key") == F.col("k"), "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(without, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, row, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS content
  FROM (SELECT *, unnest(range(0, len(w) - 49)) AS i FROM docs WHERE len(w) >= 50)),
least AS (
  SELECT content, min(doc_id) AS lo FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT row, unnest(range(i, i + 50)) AS i FROM windows JOIN least USING (content) WHERE lo < doc_id),
removed AS (
  SELECT row, count(*) AS n FROM gone GROUP BY row),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS kept
  FROM (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM docs) ANTI JOIN gone USING (row, i)
  GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (row) LEFT JOIN kept USING (row)
"""
