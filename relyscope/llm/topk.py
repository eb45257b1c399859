"""Exact top-k by inner product with pivot-table elimination.

Components become integers floor(1024 * x). Inner product becomes distance by
one more coordinate: a candidate gets sqrt(M2 - |x|^2) (M2: the largest squared
norm), a query 0, so |q - x|^2 = |q|^2 + M2 - 2 q.x. Distances of all vectors to
``PIVOTS`` pivots (centres of a bounded sample) are computed once and stored. For a
query, the largest |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x),
hence an upper bound of the score.

Vectors near one pivot form blocks, and every block keeps its least and greatest
distance to each pivot: with these the same bound holds for a whole block. A first
pass opens each query's ``FIRST`` blocks of highest bound; the k-th score found is a cut
that any block must reach to be opened in the second pass. Only blocks that some
query opens travel, each to the block of queries (near each other too) that opens it.
Inside a block candidates are scored in order of their own bound until no bound left
reaches the k-th score. How many blocks stay closed depends on the data; vectors
without any clusters open nearly all.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do null ids; rows are separate candidates and queries,
also where vec_ids repeat (a query's answers hold every other row of its own id,
and a repeated query id has its answers once a row); shorter vectors are filled with
zeros. Scores are exact up to 2^63. Ties go to the smaller vec_id. With no query, or only
one vector, the result is empty. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, read, stored

by_value(__name__)

PIVOTS = 32
#: Pivots are chosen, far from each other, among so many vectors at most.
PIVOT_SAMPLE = 2_000
BLOCK = 2_048
QUERY_BLOCK = 512
CHUNK = 256
#: Blocks that a query opens first; block bounds that are looked at together.
FIRST, BOUNDS = 2, 1_024
EXACT = 2.0 ** 53  # floats hold integers up to here


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)
    x = F.transform("embedding", lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    return table.where(fit & F.col("vec_id").isNotNull()).select("vec_id", x.alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a float matrix, filled with zeros to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (x, extra) to the pivots."""
    full = np.concatenate([x, extra[:, None]], axis=1)
    square = (full ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``x`` chosen one by one, each farthest from those chosen."""
    chosen = [0]
    least = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def centres(x: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres of the rows of ``x``, from rows that are far apart."""
    c = far_apart(x, n)
    for _ in range(rounds):
        nearest = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.array([x[nearest == k].mean(0) if (nearest == k).any() else c[k] for k in range(len(c))])
    return c


def highest(distance: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Upper bounds of scores, from lower bounds of distances; with room for rounding."""
    reach = float(q @ q) + most
    return (reach - np.square(distance)) / 2 + 1e-9 * reach + 0.5


def best(q, row, dq, x, rows, ids, dx, most: float, k: int, cut: float):
    """(ids, scores) of the k best rows of ``x`` for one query, exactly, as far as they
    reach ``cut``."""
    bound = np.abs(dx - dq).max(1)
    order = np.argsort(bound, kind="stable")
    order = order[rows[order] != row]
    top = highest(bound[order], q, most)
    whole = most >= EXACT
    got_ids, got = np.empty(0, np.int64), np.empty(0, np.int64 if whole else np.float64)
    for at in range(0, len(order), CHUNK):
        if top[at] < cut or (len(got) >= k and top[at] < got[k - 1]):
            break
        some = order[at:at + CHUNK]
        score = x[some].astype(np.int64) @ q.astype(np.int64) if whole else x[some] @ q
        got_ids, got = np.concatenate([got_ids, ids[some]]), np.concatenate([got, score])
        keep = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[keep], got[keep]
    return got_ids, got


def packed(group: pa.Table, key: str, width: int) -> pa.Table:
    """A block as one row of raw arrays."""
    raw = lambda x: pa.array([x.tobytes()], pa.binary())
    d = matrix(group.column("d"), PIVOTS)
    return pa.table({
        key: group.column(key)[:1], "rows": raw(group.column("row").to_numpy().astype(np.int64)),
        "ids": raw(group.column("vec_id").to_numpy().astype(np.int64)), "xs": raw(matrix(group.column("x"), width)),
        "ds": raw(d), "low": raw(d.min(0)), "high": raw(d.max(0))})


def bundled(group: pa.Table) -> pa.Table:
    """The bounds of up to ``BOUNDS`` blocks as one row."""
    joined = lambda c: pa.array([b"".join(group.column(c).to_pylist())], pa.binary())
    return pa.table({"bundle": group.column("bundle")[:1], "cbs": pa.array([group.column("cb").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "lows": joined("low"), "highs": joined("high")})


def floats(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def rows_of(batches, columns: list[str]):
    for b in batches:
        for r in range(b.num_rows):
            yield {c: b.column(c)[r].as_py() for c in columns}


def block_bounds(v: dict, width: int, most: float):
    """For each query of a row: (number, cut, blocks opened before, upper bounds by block)."""
    low, high = floats(v["lows"], PIVOTS), floats(v["highs"], PIVOTS)
    cuts = {c["q"]: (c["cut"], c["opened"]) for c in v.get("cuts") or ()}
    for i, (q, dq) in enumerate(zip(floats(v["q_xs"], width), floats(v["q_ds"], PIVOTS))):
        gap = np.maximum(np.maximum(dq - high, low - dq), 0).max(1)
        yield i, *cuts.get(i, (None, [])), highest(gap, q, most)


RAW = "rows binary, ids binary, xs binary, ds binary, low binary, high binary"


def search(vectors: DataFrame, is_query, k: int) -> tuple[DataFrame, DataFrame, int]:
    """The top k of ``vectors`` (vec_id, x: array<long>) for the rows where ``is_query``
    holds; the pairs (qb, cb) of query block and block that were opened; and how many there are."""
    spark = vectors.sparkSession
    vectors = stored(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    n, n_queries, width, most = vectors.agg(
        F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("x")), F.max(square)).first()
    if not n_queries:
        return (spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"),
                spark.createDataFrame([], "qb int, cb int"), 0)
    picked = vectors.orderBy(F.xxhash64("vec_id", "row"), "row").limit(PIVOT_SAMPLE).select("x").toArrow()
    sample = matrix(picked.column("x"), width)
    lift = lambda x: np.sqrt(np.maximum(most - (x ** 2).sum(1), 0))
    pivots = centres(np.concatenate([sample, lift(sample)[:, None]], axis=1), PIVOTS)
    pivots = np.concatenate([pivots, np.repeat(pivots[:1], PIVOTS - len(pivots), axis=0)])

    def measured(batches, query: bool):
        for b in batches:
            x = matrix(b.column("x"), width)
            d = to_pivots(x, np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x ** 2).sum(1), 0)), pivots)
            yield pa.RecordBatch.from_pydict({
                "row": b.column("row"), "vec_id": b.column("vec_id"), "x": b.column("x"), "near": pa.array(d.argmin(1).astype(np.int32)),
                "d": pa.ListArray.from_arrays(np.arange(0, d.size + 1, PIVOTS, dtype=np.int32), d.ravel())})

    schema = "row long, vec_id long, x array<long>, near int, d array<double>"

    def blocked(table: DataFrame, size: int, key: str) -> tuple[DataFrame, int]:
        # a pivot's neighbourhood is split by hash into blocks of bounded size
        splits = {r["near"]: -(-r["n"] // size) for r in table.groupBy("near").agg(F.count("*").alias("n")).collect()}
        first = np.cumsum([0] + [splits.get(i, 0) for i in range(PIVOTS)]).tolist()
        per = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("near") + 1)
        dealt = table.withColumn(key, (per(first[:-1]) + F.pmod(F.xxhash64("row"), per(
            [max(1, splits.get(i, 0)) for i in range(PIVOTS)]))).cast("int"))
        return dealt.groupBy(key).applyInArrow(lambda g: packed(g, key, width), f"{key} int, {RAW}"), first[-1]

    blocks, n_cb = blocked(stored(vectors.mapInArrow(lambda it: measured(it, False), schema), "pivots"), BLOCK, "cb")
    blocks = stored(blocks, "blocks")
    asked, n_qb = blocked(stored(vectors.where(is_query).mapInArrow(lambda it: measured(it, True), schema), "asked"), QUERY_BLOCK, "qb")
    asked = stored(asked.select("qb", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "xs", "ds")]), "queries")
    n_bundles = -(-n_cb // BOUNDS)
    bounds = stored(blocks.select("cb", "low", "high", F.floor(F.col("cb") / BOUNDS).cast("int").alias("bundle")).groupBy("bundle").applyInArrow(
        bundled, "bundle int, cbs binary, lows binary, highs binary"), "bounds")

    def bounded(batches, columns: list[str], wanted):
        for v in rows_of(batches, ["qb", "cbs", "lows", "highs", "q_xs", "q_ds", *columns]):
            cbs = np.frombuffer(v["cbs"], np.int64)
            got = [(i, wanted(cbs, cut, opened, top), top) for i, cut, opened, top in block_bounds(v, width, most)]
            yield pa.RecordBatch.from_pydict({
                "qb": pa.array(np.full(sum(len(x) for _, x, _ in got), v["qb"], np.int32)),
                "q": np.concatenate([np.full(len(x), i, np.int32) for i, x, _ in got]),
                "cb": cbs[np.concatenate([x for _, x, _ in got])].astype(np.int32), "top": np.concatenate([t[x] for _, x, t in got])})

    def all_bounds(queries: DataFrame, columns: list[str], wanted) -> DataFrame:
        every = queries.select("qb", "q_xs", "q_ds", *columns, F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"))
        return every.join(bounds, "bundle").mapInArrow(lambda it: bounded(it, columns, wanted), "qb int, q int, cb int, top double")

    def opened(batches):
        for v in rows_of(batches, ["rows", "ids", "xs", "ds", "q_rows", "q_ids", "q_xs", "q_ds", "asks", "qb"]):
            rows, ids = np.frombuffer(v["rows"], np.int64), np.frombuffer(v["ids"], np.int64)
            x, d, qx, qd = floats(v["xs"], width), floats(v["ds"], PIVOTS), floats(v["q_xs"], width), floats(v["q_ds"], PIVOTS)
            q_rows, q_ids = np.frombuffer(v["q_rows"], np.int64), np.frombuffer(v["q_ids"], np.int64)
            found = [(a["q"], *best(qx[a["q"]], q_rows[a["q"]], qd[a["q"]], x, rows, ids, d, most, k, -np.inf if a["cut"] is None else a["cut"])) for a in v["asks"]]
            q = np.concatenate([np.full(len(i), n, np.int64) for n, i, _ in found])
            yield pa.RecordBatch.from_pydict({
                "qb": pa.array(np.full(len(q), v["qb"], np.int32)), "q": pa.array(q.astype(np.int32)), "query_id": q_ids[q],
                "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found]).astype(np.int64)})

    def answers(pairs: DataFrame) -> DataFrame:
        """The k best of the blocks that queries open (qb, q, cb, cut)."""
        asks = pairs.groupBy("qb", "cb").agg(F.collect_list(F.struct("q", "cut")).alias("asks"))  # a query block's at most
        return asks.join(blocks, "cb").join(asked, "qb").mapInArrow(opened, "qb int, q int, query_id long, vec_id long, score long")

    ranked = lambda found: found.withColumn("rank", F.row_number().over(
        Window.partitionBy("qb", "q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    nearest = lambda cbs, cut, before, top: np.argsort(-top, kind="stable")[:FIRST]
    first = stored(all_bounds(asked, [], nearest).withColumn("at", F.row_number().over(
        Window.partitionBy("qb", "q").orderBy(F.desc("top"), "cb"))).where(F.col("at") <= FIRST).select(
        "qb", "q", "cb", F.lit(None).cast("double").alias("cut")), "first")
    early = stored(ranked(answers(first)), "early")
    reached = early.where(F.col("rank") == k).select("qb", "q", F.col("score").cast("double").alias("cut"))
    cuts = first.groupBy("qb", "q").agg(F.collect_list("cb").alias("opened")).join(reached, ["qb", "q"], "left").groupBy("qb").agg(
        F.collect_list(F.struct("q", "cut", "opened")).alias("cuts"))
    left = lambda cbs, cut, before, top: np.flatnonzero((top >= (-np.inf if cut is None else cut)) & ~np.isin(cbs, before))
    told = all_bounds(asked.join(cuts, "qb"), ["cuts"], left).join(reached, ["qb", "q"], "left").select("qb", "q", "cb", "cut")
    second = stored(told, "second")
    pairs = first.select("qb", "cb").union(second.select("qb", "cb")).distinct()
    result = ranked(early.drop("rank").union(answers(second))).select("query_id", "rank", "vec_id", "score")
    return result, pairs, n_qb * n_cb


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vectors`` (vec_id, x: array<long>);
    queries are the rows where ``is_query`` holds."""
    return search(vectors, is_query, k)[0]


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH fit AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scores AS (
  SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 100 = 0 AND c.row <> q.row),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
