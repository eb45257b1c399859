"""Exact N-gram Jaccard join with a token-group matrix.

A document's set holds its distinct five-word shingles as 64-bit tokens. Two
documents link when their sets' Jaccard similarity is 3/4 or more. Equal sets are
one node. Then:

1. Order. Tokens are ordered by (frequent, hash), where a token is frequent if its
   bucket in a count array over all documents stands out. Linked documents
   share a token among the first n - ceil(3n/4) + 1 of each (its prefix).
2. Groups. Nodes with equal min-hashes meet in blocks of bounded size, where links
   are verified exactly; connected nodes form groups, all others stand alone.
3. Matrix. Each group's token union (of its members' prefixes) is stored as rows
   (token, group). Joined with itself it gives the overlap of every two groups
   that share a token; no pair of members can link unless that overlap reaches a
   bound from the groups' smallest and largest sets.
4. Opening. Only groups above the bound are opened, block by block, and their
   members compared exactly, over the whole texts, until one link is found.

Components of all verified links are exact: steps 2 to 4 lose no link between
different groups, and links within a group change nothing.

Defined results: null, empty and wordless texts have an empty set and link with
nothing, not even each other; texts of one to four words have one token;
repeated rows share a node. Extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read, stored, words
from .components import components
from .packed import numbers, pack_rows, packed_schema
from .wordseq import pieces, word_hashes

by_value(__name__)

SHINGLE = 5
# Jaccard 3/4: overlap >= 3/7 of the sizes' sum, smaller size >= 3/4 of the larger.
#: Buckets of the token counts (CHUNKS rows of CHUNK): a bit each goes to the executors.
CHUNK, CHUNKS = 1 << 16, 64
#: A bucket is frequent above its mean by so many deviations and tokens.
DEVIATIONS, LEAST_EXCESS = 8.0, 64
#: Min-hash rounds of the grouping and nodes a block.
ROUNDS, BLOCK = 4, 128
SALTS = 64  # parts of a frequent token's rows
PREFIX = {"token": np.int64, "salt": np.int32, "node": np.int64, "n": np.int64}
DEALS, MANY = 4_096, 1 << 18  # parts that prefix rows are dealt to; rows that are packed at once
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def token_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct tokens (uint64) of a document's word hashes."""
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    t = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        t = (t ^ (t >> np.uint64(31))) * np.uint64(MIX[j]) + h[j:len(h) - k + 1 + j]
    t = (t ^ (t >> np.uint64(33))) * np.uint64(MIX[4])
    t = (t ^ (t >> np.uint64(29))) * np.uint64(MIX[1])
    return np.unique(t ^ (t >> np.uint64(32)))


def token_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ``token_set`` of each text, A-Z lower-cased, one behind the other, and where each starts and ends."""
    h, first = word_hashes(pc.ascii_lower(texts))
    words = np.diff(first)
    k = np.minimum(SHINGLE, words)
    n = np.where(words > 0, words - k + 1, 0)
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(first[:-1] - (ends - n), n)
    size = np.repeat(k, n)
    short = bool((k[n > 0] < SHINGLE).any())
    h = np.append(h, np.zeros(SHINGLE, np.uint64))
    t = size.astype(np.uint64)
    for j in range(SHINGLE):
        longer = (t ^ (t >> np.uint64(31))) * np.uint64(MIX[j]) + h[at + j]
        t = np.where(size > j, longer, t) if short else longer
    t = (t ^ (t >> np.uint64(33))) * np.uint64(MIX[4])
    t = (t ^ (t >> np.uint64(29))) * np.uint64(MIX[1])
    t ^= t >> np.uint64(32)
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        t[a:b].sort()
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    new[(ends - n)[n > 0]] = True
    return t[new], np.append(0, np.cumsum(new))[np.append(0, ends)]


def token_sets(texts: pa.Array) -> list[np.ndarray]:
    """``token_set`` of each text, A-Z lower-cased."""
    sets = []
    for part in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
        t, first = token_lists(part.column("text"))
        sets += [t[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return sets


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def nodes_of(t: np.ndarray, first: np.ndarray) -> list[int | None]:
    """``node_of`` each set of ``token_lists``; empty ones have none."""
    return [node_of(t[a:b]) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def unseen(nodes: list[int | None], seen: set[int]) -> np.ndarray:
    """Whether each node is met for the first time; ``seen`` takes it in."""
    new = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        if node is not None and node not in seen:
            seen.add(node)
            new[i] = True
    return new


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens * np.uint64(MIX[2]) >> np.uint64(64 - 22)).astype(np.int64)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * |intersection| >= 75 * |union|, for sorted distinct tokens."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x) or 4 * len(x) < 3 * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 4 * both >= 3 * (len(x) + len(y) - both)


def described(batches):
    """Per document: key, n, node and min-hashes; per task: its token counts."""
    counts, seen = np.zeros(CHUNK * CHUNKS, np.uint16), set()
    names = ["doc_id", "key", "n", "node", *[f"m{r}" for r in range(ROUNDS)], "chunk", "counts"]
    for b in pieces(batches, "text"):
        t, first = token_lists(b.column("text"))
        n = np.diff(first)
        none = n == 0
        nodes = nodes_of(t, first)
        mins = np.zeros((ROUNDS, len(n)), np.int64)
        for r in range(ROUNDS if len(t) else 0):
            h = (t ^ np.uint64(MIX[r])) * np.uint64(MIX[(r + 1) % 5])
            mins[r, ~none] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), first[:-1][~none]).view(np.int64)
        at, c = np.unique(bucket_of(t[np.repeat(unseen(nodes, seen), n)]), return_counts=True)
        counts[at] = np.minimum(counts[at] + c.astype(np.int64), 65_535)
        k = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), pa.array(n.astype(np.int64)), pa.array(nodes, pa.int64()),
             *[pa.array(m, mask=none) for m in mins], pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    used = [c for c in range(CHUNKS) if counts[c * CHUNK:(c + 1) * CHUNK].any()]
    packed = [zlib.compress(counts[c * CHUNK:(c + 1) * CHUNK].astype(np.uint32).tobytes(), 1) for c in used]
    yield pa.RecordBatch.from_arrays(
        [*[pa.nulls(len(used), pa.int64())] * (4 + ROUNDS), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)


def summed(batches):
    """Sums of count chunks, one row a chunk."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("counts")):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.astype(np.uint32).tobytes(), 1) for s in sums.values()], pa.binary())],
        ["chunk", "counts"])


def frequent_buckets(info: DataFrame) -> np.ndarray:
    """A flag a bucket, from the counts of all documents (fixed size, to the driver)."""
    schema = "chunk int, counts binary"
    per_task = info.where("chunk is not null").select("chunk", "counts").mapInArrow(summed, schema)
    counts = np.zeros(CHUNK * CHUNKS, np.int64)
    for row in per_task.repartition("chunk").mapInArrow(summed, schema).collect():
        counts[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    mean = counts.mean()
    return counts > mean + DEVIATIONS * np.sqrt(mean) + LEAST_EXCESS


def prefix_rows(batches, frequent: bytes):
    """(token, salt, node, n) of each distinct set's prefix, once a task, packed."""
    flags, seen = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool), set()
    held, many = [], 0

    def let_go():
        rows = {c: np.concatenate([x[c] for x in held]) for c in PREFIX}
        return pack_rows(rows, PREFIX, rows["token"].view(np.uint64) + rows["salt"].astype(np.uint64) * np.uint64(MIX[3]), DEALS)

    for b in pieces(batches, "text"):
        t, first = token_lists(b.column("text"))
        nodes = nodes_of(t, first)
        own = unseen(nodes, seen)
        n = np.diff(first)
        t, n = t[np.repeat(own, n)], n[own]
        if not len(t):
            continue
        node = np.array([x for x, y in zip(nodes, own) if y], np.int64)
        of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        often = flags[bucket_of(t)]
        before = np.cumsum(often) - often  # frequent tokens ahead, of all sets
        before -= before[start][of]
        few = n - np.bincount(of, often, len(n)).astype(np.int64)
        place = np.where(often, few[of] + before, np.arange(len(t)) - start[of] - before)
        taken = np.flatnonzero(place < (n + -3 * n // 4 + 1)[of])
        salt = np.where(often, 1 + node[of] % SALTS, 0)
        held.append({"token": t[taken].view(np.int64), "salt": salt[taken], "node": node[of[taken]], "n": n[of[taken]]})
        many += len(taken)
        if many >= MANY:
            yield let_go()
            held, many = [], 0
    if held:
        yield let_go()


def shared_rows(batches):
    """Of a partition by (token, salt): distinct rows, and of a rare token only if two
    nodes have it (a frequent token's rows lie in several partitions)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    token, salt, node, n = (np.concatenate([numbers(b.column(c), k) for b in got]) for c, k in PREFIX.items())
    order = np.argsort(token)
    same = token[order[1:]] == token[order[:-1]]
    order = order[(salt[order] > 0) | np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # most tokens are of one row
    order = order[np.lexsort((node[order], token[order]))]
    token, salt, node, n = token[order], salt[order], node[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, salt, node, n = token[new], salt[new], node[new], n[new]
    same = token[1:] == token[:-1]
    several = (salt > 0) | np.concatenate([[False], same]) | np.concatenate([same, [False]])
    for at in range(0, len(token), 65_536):
        s = slice(at, at + 65_536)
        yield pa.RecordBatch.from_pydict({"token": token[s][several[s]], "node": node[s][several[s]], "n": n[s][several[s]]})


def sets_of(nodes: np.ndarray, texts: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The token set of each node, once."""
    every, one = np.unique(nodes, return_index=True)
    return dict(zip(every.tolist(), token_sets(pa.chunked_array(texts.take(pa.array(one)).chunks, pa.string()).combine_chunks())))


def forest(nodes: list[int], sets: dict[int, np.ndarray]):
    """Verified links that span a block's connected nodes."""
    root = np.arange(len(nodes))
    for i in range(len(nodes)):
        for j in range(i):
            if root[i] != root[j] and linked(sets[nodes[i]], sets[nodes[j]]):
                root[root == root[i]] = root[j]
                yield nodes[i], nodes[j]


def forests(batches):
    """``forest`` of each block of a partition, whose rows lie together."""
    def found(rows: pa.Table) -> pa.RecordBatch:
        block, nodes = rows.column("block").to_numpy(), rows.column("node").to_numpy()
        sets = sets_of(nodes, rows.column("text"))
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        links = [link for a, b in zip(first, np.append(first[1:], len(block))) for link in forest(nodes[a:b].tolist(), sets)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []  # rows of a block that may go on
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block").to_numpy()
        cut = int(np.flatnonzero(block == block[-1])[0])
        if held and (cut or held[0].column("block")[0].as_py() != block[0]):
            yield found(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        elif cut:
            yield found(pa.Table.from_batches([b.slice(0, cut)]))
        held.append(b.slice(cut))
    if held:
        yield found(pa.Table.from_batches(held))


def bridges(batches):
    """Of each row, two blocks of different groups, one verified link if there is any:
    a group's members are connected, so one link joins the groups."""
    for batch in batches:
        a, b = [], []
        columns = [batch.column(c) for c in ("xs", "ys")]
        sets = sets_of(np.concatenate([c.flatten().to_numpy() for c in columns]),
                       pa.chunked_array([batch.column(c).flatten() for c in ("x", "y")], pa.string()))
        for xs, ys in zip(*(c.to_pylist() for c in columns)):
            found = next(((i, j) for i in xs for j in ys if linked(sets[i], sets[j])), None)
            if found:
                a.append(found[0])
                b.append(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def block_links(info: DataFrame, texts: DataFrame) -> DataFrame:
    """Links found among nodes with equal min-hashes, ``texts`` being (node, text)."""
    hashes = info.where("node is not null").select("node", *[f"m{r}" for r in range(ROUNDS)]).distinct()
    each = stored(hashes.select("node", F.posexplode(F.array(*[f"m{r}" for r in range(ROUNDS)])).alias("round", "m")), "rounds")
    meet = each.groupBy("round", "m").agg(F.count("*").alias("c")).where("c > 1")
    salt = F.pmod(F.xxhash64("node", "round"), F.ceil(F.col("c") / BLOCK))
    dealt = each.join(meet, ["round", "m"]).select("node", F.xxhash64("round", "m", salt).alias("block"))
    rows = dealt.join(texts, "node").select("block", "node", "text")
    return stored(rows.repartition("block").sortWithinPartitions("block").mapInArrow(forests, "a long, b long"), "links")


def group_links(shared: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """A verified link of every two groups that have one."""
    rows = shared.join(groups, "node", "left").withColumn("g", F.coalesce("root", "node"))
    members = stored(rows.select("g", "node", "n").distinct(), "members")
    spans = members.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))
    matrix = stored(rows.select("token", "g").distinct().join(spans, "g"), "matrix")
    x, y = matrix.alias("x"), matrix.alias("y")
    fits = (4 * F.col("x.high") >= 3 * F.col("y.low")) & (4 * F.col("y.high") >= 3 * F.col("x.low"))
    overlap = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g")) & fits).groupBy(
        F.col("x.g").alias("g"), F.col("y.g").alias("o"), F.col("x.low").alias("low"), F.col("x.high").alias("high"),
        F.col("y.low").alias("o_low"), F.col("y.high").alias("o_high")).agg(F.count("*").alias("c"))

    def need(a: str, b: str) -> Column:
        """28 * (prefix tokens that sets of these sizes share at least), less than that by one token."""
        return 12 * (F.col(a) + F.col(b)) - 21 * F.greatest(a, b) - 28

    opened = stored(overlap.where(28 * F.col("c") >= F.least(need("high", "o_low"), need("low", "o_high"))).select("g", "o"), "opened")
    # a group is opened block by block: a pair of blocks is a row, never a pair of members
    wanted = opened.select("g").union(opened.select(F.col("o").alias("g"))).distinct()
    dealt = members.join(wanted, "g").join(spans.select("g", "size"), "g").select(
        "g", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("part"))
    blocks = stored(dealt.join(texts, "node").groupBy("g", "part").agg(
        F.collect_list(F.struct("node", "text")).alias("nodes")), "blocks")
    mine = blocks.select("g", F.col("nodes").alias("left"))
    other = blocks.select(F.col("g").alias("o"), F.col("nodes").alias("right"))
    pairs = opened.join(mine, "g").join(other, "o").select(
        F.col("left.node").alias("xs"), F.col("right.node").alias("ys"), F.col("left.text").alias("x"), F.col("right.text").alias("y"))
    return stored(pairs.mapInArrow(bridges, "a long, b long"), "links")


def joined(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, node, root`` of every row of ``docs`` (doc_id, text); rows of one
    root are connected by links, a null root has no words."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    fields = ", ".join(f"m{r} long" for r in range(ROUNDS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    info = stored(keyed.mapInArrow(described, f"doc_id {kind}, key long, n long, node long, {fields}, chunk int, counts binary"), "sets")
    frequent = np.packbits(frequent_buckets(info)).tobytes()
    info = info.where("chunk is null")
    rows = docs.select("text").mapInArrow(lambda it: prefix_rows(it, frequent), packed_schema(PREFIX))
    shared = stored(rows.repartition("deal").mapInArrow(shared_rows, "token long, node long, n long"), "prefixes")
    # the text of each node that shares a token, from one of its documents
    chosen = info.join(shared.select("node").distinct(), "node").groupBy("node").agg(F.min("key").alias("key"))
    texts = stored(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").join(chosen.hint("merge"), "key").dropDuplicates(["node"]).select("node", "text"), "texts")
    first = block_links(info, texts)
    links = first.union(group_links(shared, components(first), texts))
    return info.select("doc_id", "key", "n", "node").join(components(links), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(joined(read(spark, sf_dir, "documents")).select("doc_id", "n", "root"), "joined")
    least = rows.where("root is not null").groupBy(F.col("root").alias("of")).agg(F.min("doc_id").alias("least"))
    return rows.join(least, F.col("root") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component, once each, and
    all rows without words."""
    rows = joined(docs).where("root is not null")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("of"))
    # no names to clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text", F.xxhash64("doc_id", "text").alias("key"))
    wordless = F.size(words(F.col("text"))) == 0
    once = keyed.where(~wordless).join(kept, F.col("key") == F.col("of"), "left_semi").dropDuplicates(["key"])
    return once.union(keyed.where(wordless)).select(*["text" if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


OP10_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM docs),
tokens AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS MATERIALIZED (SELECT x, y FROM common WHERE 100 * c >= 75 * (nx + ny - c)),
links AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY 1) r ON r.x = s.doc_id
"""
