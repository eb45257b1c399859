"""Toxicity: a convolutional text classifier over hashed word embeddings.

Spark turns every whole text into hashed ids, three a word (the word and its first
four and five letters, lower-cased, punctuation as blanks). A word's embedding is
the sum of its three. Filters of widths 1, 2 and 3 slide over the words, max
pooling keeps each filter's highest response, and a logistic layer gives a raw
score. Training (numpy, Adam) starts on the driver with a bounded sample of labelled
documents and then takes every labelled document whole: in each of ``ROUNDS`` rounds the
documents, dealt to groups of about ``GROUP`` by a hash, each train a copy of the network on
the executors, and Spark adds up what the copies changed; a row of weights moves by the
mean of the groups that moved it. All documents of a second part of the training folds
calibrate one threshold a language, the language itself guessed from the hashed words (counted
over all documents of the first part): Spark counts them by language and logit, in steps of
1 / ``FINE``. Scores are shifted so that every language's threshold sits at 0.3.

Of a text of over ``TRAIN_WORDS`` words the start alone takes ``WINDOWS`` windows at hashed
places, one in each equal part, so the driver gets at most ``TRAIN_ROWS`` documents a label
of ``TRAIN_WORDS`` words each, about 120 MB, and sums of the size of the network.

Defined results: null, empty and wordless texts have the pooled response of one
blank, so a low score; texts of any length are scored whole; without labels of both
kinds (as in empty tables) every score is 0; repeated rows and equal texts are scored
alike (ties); null labels are not learned from, and of rows that share a labelled doc_id
the one of smallest text is; an empty documents table gives an empty result. Other
columns pass through ``score_documents``, but those named ids, score or predicted, which
the result replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HELD_OUT_FOLD, bounded_sample, by_value, fold, read, stored

by_value(__name__)

BUCKETS = 1 << 16
IDS = 3  # hashed ids a word
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
THRESHOLD = 0.3
#: Bounds of the sample that training starts with: documents a label, and words a document.
TRAIN_ROWS, TRAIN_WORDS = 2_500, 2_000
#: Windows of a longer document, TRAIN_WORDS together.
WINDOWS = 8
#: Fold of the training rows that calibrates instead of training.
CALIBRATION_FOLD = 3
#: A language with fewer calibration positives takes the threshold of all.
LEAST_POSITIVES = 15
STEPS, BATCH, RATE = 800, 32, 0.01
#: Training on all labelled documents.
ROUNDS, GROUP, LATER_RATE = 2, 8_192, 0.002
SCALE = 1 << 24  # sums over groups are whole numbers, so their order does not matter
FINE, WIDEST = 256, 64  # steps of a logit that thresholds are told in, and the largest logit
SEGMENT = 65_536  # words held at once
PUNCTUATION = "\t\n\x0b\x0c\r.,;:!?\"'()[]{}|*%$&#<>-_/\\+=~`^@"


def hashed_ids(text: Column) -> Column:
    """array<int>: IDS bucket numbers a word, flattened; bucket 0 is the blank."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, " " * len(PUNCTUATION))
    words = F.array_remove(F.split(plain, " "), "")
    bucket = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(BUCKETS - 1)) + 1).cast("int")
    return F.flatten(F.transform(words, lambda w: F.array(
        bucket(w), bucket(F.left(w, F.lit(4)), F.lit(4)), bucket(F.left(w, F.lit(5)), F.lit(5)))))


def trained_words(ids: Column, doc_id: Column) -> Column:
    """``hashed_ids`` of TRAIN_WORDS words at most: of longer texts hashed windows."""
    n, own = F.size(ids) / IDS, TRAIN_WORDS // WINDOWS
    start = lambda j: (F.floor(n * j / WINDOWS) + F.pmod(F.xxhash64(doc_id, j), F.floor(n / WINDOWS) - own + 1)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda j: F.slice(ids, start(j) * IDS + 1, own * IDS))
    return F.when(n > TRAIN_WORDS, F.flatten(windows)).otherwise(ids)


class Network:
    """Weights and the forward pass."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.p = {"E": normal(BUCKETS, DIM) * 0.1, "V": normal(FILTERS * len(WIDTHS)) * 0.1, "c": np.zeros(1, np.float32)}
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = normal(w, DIM, FILTERS) * np.float32(1 / np.sqrt(w * DIM))
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        e = self.p["E"]
        x = e[ids[:, 0]]
        for k in range(1, IDS):
            x = x + e[ids[:, k]]
        return x

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Filter responses at every start; the last width - 1 rows of x are blanks."""
        n = len(x) - max(WIDTHS) + 1
        return sum(x[j:j + n] @ self.p[f"W{width}"][j] for j in range(width)) + self.p[f"b{width}"]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """Rectified highest responses over one document's words (n x IDS)."""
        top = np.zeros(FILTERS * len(WIDTHS), np.float32)
        over = max(WIDTHS) - 1
        for at in range(0, max(1, len(ids)), SEGMENT):
            part = ids[at:at + SEGMENT + over]
            blanks = over if at + SEGMENT + over > len(ids) else 0
            x = self.embedded(np.concatenate([part, np.zeros((blanks + (not len(part)), IDS), part.dtype)]))
            top = np.maximum(top, np.concatenate([self.responses(x, w).max(0) for w in WIDTHS]))
        return top

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Raw scores; short documents share one pass, with blanks between them."""
        out, over, at = np.empty(len(docs)), max(WIDTHS) - 1, 0
        while at < len(docs):
            end, held = at, 0
            while end < len(docs) and (end == at or held + len(docs[end]) <= SEGMENT):
                held += len(docs[end]) + over + 1
                end += 1
            some = docs[at:end]
            if len(some) == 1:
                pools = self.pooled(some[0])[None]
            else:
                lengths = np.array([max(1, len(d)) + over for d in some])
                starts = np.cumsum(lengths) - lengths
                ids = np.zeros((lengths.sum(), IDS), np.int64)
                for s, d in zip(starts, some):
                    ids[s:s + len(d)] = d
                x = self.embedded(ids)
                # windows that start on a document's trailing blanks reach into the next: not looked at
                real = np.ones(len(ids), bool)
                for k in range(over):
                    real[starts + lengths - 1 - k] = False
                best = []
                for w in WIDTHS:
                    r = self.responses(np.concatenate([x, np.zeros((over, DIM), np.float32)]), w)
                    r[~real] = 0
                    best.append(np.maximum.reduceat(r, starts))
                pools = np.maximum(np.concatenate(best, 1), 0)
            out[at:end] = pools @ self.p["V"] + self.p["c"]
            at = end
        return out


class Training:
    """Adam on the logistic loss. Max pooling passes gradients to one place a filter."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.p.items()}

    def peaks(self, ids: np.ndarray) -> tuple[list, list]:
        """By width, each filter's highest response and its place; ids end with blanks."""
        over, net = max(WIDTHS) - 1, self.net
        heights = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        places = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
        for at in range(0, len(ids) - over, SEGMENT):
            x = net.embedded(ids[at:at + SEGMENT + over])
            for k, w in enumerate(WIDTHS):
                r = net.responses(x, w)
                top = r.argmax(0)
                best = r[top, np.arange(FILTERS)]
                places[k] = np.where(best > heights[k], at + top, places[k])
                heights[k] = np.maximum(heights[k], best)
        return heights, places

    def __call__(self, docs: list[np.ndarray], labels: list[int], weights: list[float]) -> None:
        """One step."""
        net, over = self.net, max(WIDTHS) - 1
        grad = {k: np.zeros_like(v) for k, v in net.p.items() if k != "E"}
        rows, row_grads = [], []
        for doc, label, weight in zip(docs, labels, weights):
            ids = np.concatenate([doc, np.zeros((over + (not len(doc)), IDS), np.int64)])
            heights, places = self.peaks(ids)
            pool = np.maximum(np.concatenate(heights), 0)
            d = weight * (1 / (1 + np.exp(-(pool @ net.p["V"] + net.p["c"][0]))) - label) / len(docs)
            grad["V"] += d * pool
            grad["c"] += d
            g = np.where(pool > 0, d * net.p["V"], 0).astype(np.float32).reshape(len(WIDTHS), FILTERS)
            for k, w in enumerate(WIDTHS):
                grad[f"b{w}"] += g[k]
                for j in range(w):
                    at_j = ids[places[k] + j]
                    grad[f"W{w}"][j] += net.embedded(at_j).T * g[k]
                    rows.append(at_j)
                    row_grads.append((net.p[f"W{w}"][j] * g[k]).T)
        self.steps += 1
        first, second = self.first, self.second
        correct = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        for k, g in grad.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.p[k] -= (self.rate * correct * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        # embeddings: only rows in use move
        touched, where = np.unique(np.concatenate(rows), return_inverse=True)
        sums = np.zeros((len(touched), DIM), np.float32)
        np.add.at(sums, where.reshape(-1), np.repeat(np.concatenate(row_grads), IDS, axis=0))
        first["E"][touched] += 0.1 * (sums - first["E"][touched])
        second["E"][touched] += 0.001 * (sums * sums - second["E"][touched])
        net.p["E"][touched] -= (self.rate * correct * first["E"][touched] / (np.sqrt(second["E"][touched]) + 1e-8)).astype(np.float32)
        net.p["E"][0] = 0


def trained(docs: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Network:
    """The network that training on all documents starts from."""
    net = Network(seed)
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, (labels == 0).sum() / max(1, (labels == 1).sum()), 1.0)
    step, order = Training(net, RATE), np.empty(0, np.int64)
    while step.steps < STEPS:
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(docs))])
        some, order = order[:BATCH], order[BATCH:]
        step([docs[i] for i in some], labels[some], weight[some])
    return net


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """All weights in rows of FILTERS (DIM is as wide)."""
    return np.concatenate([np.resize(p[k], (1, FILTERS)) if k == "c" else p[k].reshape(-1, FILTERS) for k in sorted(p)])


def unflat(rows: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, at = {}, 0
    for k in sorted(like):
        n = max(1, like[k].size // FILTERS)
        p[k] = rows[at:at + n].reshape(-1)[:like[k].size].reshape(like[k].shape).astype(np.float32)
        at += n
    return p


def round_over_all(net: Network, whole: DataFrame, weight: float) -> None:
    """Every document of the training folds (``whole``: by group) trains; ``net`` moves.
    weight: of a document with label 1."""
    start = net.p

    def changes(batches):
        own, step, held, n = None, None, [], 0

        def told():
            if held:
                step(*zip(*held))
            old, new = flat(start), flat(step.net.p)
            at = np.flatnonzero((old != new).any(1))
            moved = np.rint((new[at] - old[at]).astype(np.float64) * n * SCALE).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n, np.int64)),
                                               *[pa.array(np.ascontiguousarray(moved[:, i])) for i in range(FILTERS)]], names)

        for b in batches:
            for ids, label, group in zip(id_rows(b.column("ids")), b.column("toxic").to_pylist(), b.column("group").to_pylist()):
                if group != own:
                    if step:
                        yield told()
                    copy = Network.__new__(Network)
                    copy.p = {k: v.copy() for k, v in start.items()}
                    own, step, held, n = group, Training(copy, LATER_RATE), [], 0
                held.append((ids, label, weight if label else 1.0))
                n += 1
                if len(held) == BATCH:
                    step(*zip(*held))
                    held = []
        if step:
            yield told()

    names = ["at", "n", *[f"v{i}" for i in range(FILTERS)]]
    moved = whole.select("group", "toxic", "ids").mapInArrow(changes, ", ".join(["at int", "n long", *[f"v{i} long" for i in range(FILTERS)]]))
    got = moved.groupBy("at").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    rows, n = flat(start).astype(np.float64), got.column("n").to_numpy()
    step = np.stack([got.column(c).to_numpy() for c in names[2:]], 1) if got.num_rows else np.zeros((0, FILTERS))
    rows[got.column("at").to_numpy()] += step / (n[:, None] * SCALE)
    net.p = unflat(rows, start)


class Languages:
    """Which language a document's hashed words speak (add-one-smoothed counts of all)."""

    def __init__(self, whole: DataFrame):
        def spoken(batches):
            counts = {}
            for b in batches:
                for ids, lang in zip(id_rows(b.column("ids")), b.column("lang").to_pylist()):
                    if lang not in counts:
                        counts[lang] = np.zeros(BUCKETS, np.int64)
                    np.add.at(counts[lang], ids[:, 0], 1)
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                # a language without words is known too
                at = at if len(at) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "at", "n"])

        got = whole.where("lang is not null").select("lang", "ids").mapInArrow(spoken, "lang string, at int, n long").groupBy("lang", "at").agg(
            F.sum("n").alias("n")).toArrow()
        langs = got.column("lang").to_pylist()
        self.names = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.names)}
        counts = np.ones((BUCKETS, max(1, len(self.names))))
        np.add.at(counts, (got.column("at").to_numpy(), np.array([number[x] for x in langs], np.int64)), got.column("n").to_numpy())
        self.logs = np.log(counts / counts.sum(0)).astype(np.float32)

    def __call__(self, doc: np.ndarray) -> int:
        return int(sum(self.logs[doc[at:at + SEGMENT, 0]].sum(0) for at in range(0, len(doc), SEGMENT)).argmax()) if len(doc) else 0


def logit_counts(net: Network, languages: Languages, some: DataFrame) -> np.ndarray:
    """Rows (language, step of the logit, documents, of them label 1) of all of ``some``."""

    def told(batches):
        for b in batches:
            docs = id_rows(b.column("ids"))
            at = np.floor(np.clip(net.logits(docs), -WIDEST, WIDEST) * FINE)
            yield pa.RecordBatch.from_arrays([pa.array([languages(d) for d in docs], pa.int32()), pa.array(at.astype(np.int32)), b.column("toxic")],
                                             ["speaks", "at", "toxic"])

    got = some.select("toxic", "ids").mapInArrow(told, "speaks int, at int, toxic int").groupBy("speaks", "at").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits")).toArrow()
    return np.stack([got.column(c).to_numpy().astype(np.int64) for c in ("speaks", "at", "n", "hits")], 1)


def threshold(counts: np.ndarray) -> float:
    """The cut with the best F1, half-way to the next logit below."""
    at = np.unique(counts[:, 1])[::-1]
    where = np.searchsorted(-at, -counts[:, 1])
    n, hits = (np.bincount(where, counts[:, c], len(at)) for c in (2, 3))
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    best = int(f1.argmax())
    below = at[best + 1] + 1 if best + 1 < len(at) else at[best] - FINE
    return float((at[best] + below) / 2 / FINE)


class Rows(list):
    """(ids, label) of the documents that training starts with; ``whole``: the table of all
    labelled documents (group, doc_id, toxic, lang, calibrates, ids)."""

    def __init__(self, rows, whole: DataFrame):
        super().__init__(rows)
        self.whole = whole


class Model:
    """The network with its thresholds by language."""

    def __init__(self, rows: Rows):
        self.net = trained([r[0] for r in rows], np.array([r[1] for r in rows]))
        fit, calibration = (rows.whole.where(F.col("calibrates") == x) for x in (False, True))
        n = {r.toxic: r.n for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        for _ in range(ROUNDS):
            round_over_all(self.net, fit, n[0] / n[1])
        self.languages = Languages(fit)
        counts = logit_counts(self.net, self.languages, calibration)
        if counts[:, 3].sum() < LEAST_POSITIVES or (counts[:, 2] == counts[:, 3]).all():
            counts = logit_counts(self.net, self.languages, fit)
        # the empty text, of language 0, is a clean one
        blank = np.floor(np.clip(self.net.logits([np.zeros((0, IDS), np.int64)]), -WIDEST, WIDEST) * FINE)[0]
        counts = np.concatenate([counts, np.array([[0, blank, 1, 0]], np.int64)])
        self.cuts = np.full(max(1, len(self.languages.names)), threshold(counts))
        for k in range(len(self.cuts)):
            own = counts[counts[:, 0] == k]
            if own[:, 3].sum() >= LEAST_POSITIVES and (own[:, 2] > own[:, 3]).any():
                self.cuts[k] = threshold(own)

    def __call__(self, docs: list[np.ndarray]) -> np.ndarray:
        shift = np.array([self.cuts[self.languages(d)] for d in docs])
        z = self.net.logits(docs) - shift + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def id_rows(column: pa.Array) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).reshape(-1, IDS)
    return [flat[a // IDS:b // IDS] for a, b in zip(offsets[:-1], offsets[1:])]


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train and calibrate on rows outside the held-out fold; None without both labels."""
    known = labels.where((F.col("toxic").isin(0, 1)) & F.col("doc_id").isNotNull()
                         & (fold(F.col("doc_id")) != HELD_OUT_FOLD)).select("doc_id", "toxic").distinct()
    # one text a label, however often its doc_id repeats
    texts = stored(docs.select("doc_id", "text", "lang").join(known.hint("merge"), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct("text", "lang")).alias("of")), "known")
    groups = -(-known.count() // GROUP) or 1
    by_hash = lambda name: F.xxhash64("doc_id", "toxic", F.lit(name))
    hashed = texts.select("doc_id", "toxic", "of.lang", hashed_ids(F.col("of.text")).alias("ids"), by_hash("turn").alias("turn"),
                          (fold(F.col("doc_id")) == CALIBRATION_FOLD).alias("calibrates"),
                          F.pmod(by_hash("group"), F.lit(groups)).cast("int").alias("group"))
    whole = stored(hashed.repartition(groups, "group").sortWithinPartitions("group", "turn", "doc_id", "toxic"), "labelled")
    fit = whole.where(~F.col("calibrates"))
    start = [bounded_sample(fit.where(F.col("toxic") == label), TRAIN_ROWS, "doc_id") for label in (0, 1)]
    cut = start[0].union(start[1]).select("doc_id", "toxic", trained_words(F.col("ids"), F.col("doc_id")).alias("ids"))
    # sorted on arrival, so that training sees the same order on every run
    got = cut.toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    labels_of = got.column("toxic").to_pylist()
    if len(set(labels_of)) < 2:
        return None
    return Model(Rows(zip(id_rows(got.column("ids").combine_chunks()), labels_of), whole))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (with ``ids``) plus score and predicted, without ids."""
    names = [c for c in docs.columns if c not in ("ids", "score", "predicted")]
    rest = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    own = [F.col(f"row.`{c}`").alias(c) for c in names]
    if model is None:
        return docs.select(rest).select(*own, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def scored(batches):  # ships the model: BUCKETS x (DIM + languages) floats
        for b in batches:
            score = model(id_rows(b.column("ids")))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["row", "score", "predicted"])

    rows = docs.select(rest, "ids")
    return rows.mapInArrow(scored, T.StructType([
        rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])).select(
        *own, "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), hashed_ids(F.col("text")).alias("ids"))
    return score_documents(rows, model)
