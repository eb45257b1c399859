"""Sharding by Karmarkar-Karp differencing, law ``bytes``.

Equal texts form a group that no shard boundary divides. A group heavier than
1/``PARTS`` of an even shard is an item of its own; there are fewer than SHARDS *
PARTS of those at any corpus size. All lighter groups are dealt by hash to SHARDS *
PARTS items. Multi-way differencing then partitions the items: the two partial
partitions with the largest spread are combined, one's largest part with the
other's smallest, until one partition is left. Sizes, groups and items are Spark
aggregates; only the items, whose number is bounded, are differenced in one place.

Defined results: a null text has no bytes (size 16, crc32 0) and is one group,
apart from the empty text; empty tables give an empty result; repeated rows are
rows of one group; a group larger than an even share fills its shard alone, as
no law may divide it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, read, stored
from .ranks import numbered

by_value(__name__)

SHARDS = 40
OVERHEAD = 16
#: Items an even shard is made of, at least.
PARTS = 128


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over rows of k sums each (n x k).

    Returns for every row the final label of each of its k parts, and the k sums.
    """
    n, k = parts.shape
    sums = list(parts)
    heap = [(-int(p.max() - p.min()), i) for i, p in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        both = sums[a][down] + sums[b][up]
        merges.append((a, down, b, up))
        sums[a] = sums[b] = None
        sums.append(both)
        heapq.heappush(heap, (-int(both.max() - both.min()), len(sums) - 1))
    labels = [None] * len(sums)
    labels[-1] = np.arange(k)
    for i in range(len(sums) - 1, n - 1, -1):
        a, down, b, up = merges[i - n]
        for child, order in ((a, down), (b, up)):
            labels[child] = np.empty(k, np.int64)
            labels[child][order] = labels[i]
        labels[i] = None
    return np.array(labels[:n]), sums[-1]


def group_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``key, shard`` of ``groups`` (key, bytes)."""
    spark, parts = groups.sparkSession, shards * PARTS
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    light = F.concat(F.lit("part "), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("string"))
    dealt = groups.withColumn("item", F.when(F.col("bytes") * parts > total, F.col("key")).otherwise(light))
    items = dealt.groupBy("item").agg(F.sum("bytes").alias("bytes")).toArrow().sort_by(
        [("bytes", "descending"), ("item", "ascending")])  # fewer than 2 * parts rows
    if not items.num_rows:
        return dealt.select("key", F.lit(0).alias("shard"))
    vectors = np.zeros((items.num_rows, shards), np.int64)
    vectors[:, 0] = items.column("bytes").to_numpy()
    labels, _ = difference(vectors)
    placed = spark.createDataFrame(pa.table({"item": items.column("item"), "shard": pa.array(labels[:, 0].astype(np.int32))}))
    return dealt.join(placed, "item").select("key", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(F.col("text").cast("binary"))).alias("key")), "rows")
    groups = stored(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.join(group_shards(groups, shards), "key").select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
