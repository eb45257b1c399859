"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then every star is a component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    most, both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).agg(
        F.max("up"), F.max(F.col("up") * F.col("root"))).first()
    return (most or 0) <= 1 and not both


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); a root is its component's
    smallest node.

    Alternates large-star and small-star (each node's larger, then smaller
    neighbours are linked to its least neighbour) until only stars are left. Every
    round is two aggregates and joins over the edges and is written to the shared
    folder; a hub's edges are combined before the shuffle and its join can be
    split, so no node's neighbours meet in one task.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    state = stored(both.distinct(), name)
    while not is_star_forest(state):
        near = state.select("u", "v").union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.col("c")).alias("m"))
        large = stored(near.where("v > u").join(least, F.col("u") == F.col("c")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), name)
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        state = stored(small.where("u <> v").distinct(), name)
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
