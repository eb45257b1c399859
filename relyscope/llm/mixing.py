"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Every document gets a rate in (0, 2), the bounded exponential tilt
``2 * e^(l*z) / (1 + e^(l*z))`` of its size ``z`` (in units of its source's mean
size). The tilt ``l`` of a source solves the convex dual of the entropy problem
with one token constraint a source: rate-weighted words equal the target. Newton
steps run for all sources at once, each one aggregate over the compact
``(source, size, documents)`` table. Rates become copies by hash dithering,
and a per-source shift of the dither, found by weighted quantiles, brings each
source's words to its target within about one document. Rows equal in doc_id, source
and text are numbered, so each has a dither of its own and they move one by one.

Defined results: null text has size 0; null source is a source of its own, last
in order; a document of size 0 has rate 1 (one copy, no words); a source whose
target is twice its size takes every document twice; texts of any length count
whole; ties in the dither's distance move together only where two hashes are equal;
repeated rows are separate documents; an empty table gives an empty result. Columns
other than doc_id, source and text pass through ``mix_documents`` unchanged, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored, words

# Fixed weights of the query, repeating over the sources in order.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
#: Newton stops at this relative error of every source, or after so many steps.
TOLERANCE, STEPS = 1e-6, 40
#: Bins per pass and passes of the dither's weighted quantile.
BINS, PASSES = 1024, 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row a source: ``source, source_size, mean_size, target``.

    Sharing by weight with re-sharing of what exceeds ``MOST`` times a source's
    size ends at a common level: a source gets level * weight or its cap. With
    sources in order of cap / weight, the capped ones are a prefix.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    at = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1))
    cap = F.col("source_size") * F.lit(float(MOST))
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighed.withColumn("cap", cap).withColumn("ratio", cap / F.col("weight")).select(
        "*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
        (F.sum("source_size").over(everything) * share).alias("total"))
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    # Levels rise while sources are capped; the first uncapped source's level holds.
    held = F.min(F.when(F.col("ratio") >= level, F.struct(F.col("ratio"), level.alias("level")))).over(everything)
    return ranked.withColumn("level", held["level"]).select(
        "source", "source_size", "mean_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(MOST)) / (F.lit(1.0) + F.exp(-tilt * size / F.greatest(mean, F.lit(1e-9))))


def tilts(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """``source, source_size, target, mean_size, tilt`` by distributed Newton steps.

    A step is kept inside a bracket that holds the root (the dual's gradient is
    monotone); where Newton leaves it, the bracket is halved.
    """
    start = F.log(F.col("target") / F.greatest(F.col("source_size") * MOST - F.col("target"), F.lit(1e-9)))
    far = 60.0
    state = stored(goal.withColumns({
        "open": (F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST * (1 - 1e-9)),
        "low": F.lit(-far), "high": F.lit(far)}).withColumn(
        "tilt", F.when(F.col("open"), F.least(F.greatest(start, F.lit(-4.0)), F.lit(4.0))).otherwise(F.lit(far))), "tilts")
    for _ in range(STEPS):
        z = F.col("size") / F.greatest(F.col("mean_size"), F.lit(1e-9))
        w = rate(F.col("tilt"), F.col("size"), F.col("mean_size"))
        moved = sizes.join(state, sizes["source"].eqNullSafe(state["source"])).groupBy(
            state["source"], "source_size", "mean_size", "target", "open", "low", "high", "tilt").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("reached"),
            F.sum(F.col("n") * F.col("size") * z * w * (1 - w / MOST)).alias("slope"))
        gap = F.col("reached") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        stepped = moved.withColumns({"low": low, "high": high, "newton": newton, "error": F.abs(gap) / F.greatest(F.col("target"), F.lit(1e-9))})
        kept = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")
                      ).otherwise((F.col("low") + F.col("high")) / 2)
        done = ~F.col("open") | (F.col("error") <= TOLERANCE)
        state = stored(stepped.select("source", "source_size", "mean_size", "target", "open", "low", "high",
                                      F.when(done, F.col("tilt")).otherwise(kept).alias("tilt"), "error"), "tilts")
        worst = state.where("open").agg(F.max("error")).first()[0]
        state = state.drop("error")
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("source", "source_size", "mean_size", "target", "tilt")


def rated(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (key, source, size, ...) with their source's plan and dithered copies.

    ``key`` and ``rank`` seed the dither u in [0, 1): copies are floor(rate + u). The plan has
    a row a source, so Spark joins it by broadcast while it is small by its own
    measure, and else by a shuffle whose hot sources AQE splits.
    """
    # the first of equal rows has the dither that it would have alone
    seed = F.when(F.col("rank") == 0, F.xxhash64("key", F.lit("mix"))).otherwise(F.xxhash64("key", "rank", F.lit("mix")))
    u = F.pmod(seed, F.lit(1 << 52)).cast("double") / float(1 << 52)
    plan = plan.withColumnRenamed("source", "of")
    v = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).withColumn(
        "v", rate(F.col("tilt"), F.col("size"), F.col("mean_size")) + u)
    return v.withColumns({"base": F.least(F.floor("v"), F.lit(MOST)), "frac": F.col("v") - F.floor("v")})


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row's distance to its next copy more (``up``) or less, if it may move."""
    up = F.col("up")
    return rated(rows, plan).withColumns({
        "distance": F.when(up, 1 - F.col("frac")).otherwise(F.col("frac")),
        "movable": (F.col("size") > 0) & F.when(up, F.col("base") < MOST).otherwise(F.col("base") > 0)})


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix of ``docs`` (key, source, size): one row a source with its target,
    tilt, and the cut below which rows move one copy up (or down).

    What a source lacks after dithering (or has too much) is made up by the rows
    closest to their next step. The cut on that distance is a weighted quantile,
    found by PASSES aggregates over BINS bins a source, each inside the last
    pass's bin.
    """
    sizes = stored(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goal = tilts(sizes, targets(sizes, weights, share))
    reached = rated(docs, goal).groupBy("of", "source_size", "mean_size", "target", "tilt").agg(
        F.sum(F.col("base") * F.col("size")).alias("reached"))
    gap = F.col("target") - F.col("reached")
    plan = stored(reached.select(
        F.col("of").alias("source"), "source_size", "mean_size", "target", "tilt", F.abs(gap).alias("need"),
        (gap >= 0).alias("up"), F.lit(0.0).alias("cut"), F.lit(1.0).alias("width")), "plan")
    for _ in range(PASSES):
        inside = F.col("movable") & (F.col("distance") >= F.col("cut")) & (
            F.col("distance") < F.col("cut") + F.col("width"))
        bins = placed(docs, plan).where(inside).withColumn("bin", F.least(F.floor(
            (F.col("distance") - F.col("cut")) / F.col("width") * BINS), F.lit(BINS - 1))).groupBy("of", "bin").agg(
            F.sum("size").alias("words")).withColumn(
            "upto", F.sum("words").over(Window.partitionBy("of").orderBy("bin")))
        filled = plan.join(bins, F.col("source").eqNullSafe(F.col("of")), "left").groupBy(*plan.columns).agg(
            F.coalesce(F.sum(F.when(F.col("upto") <= F.col("need"), F.col("words"))), F.lit(0)).alias("full"),
            # where no bin overflows, all that is inside moves
            F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), F.col("bin"))), F.lit(BINS)).alias("split"))
        plan = stored(filled.select(
            "source", "source_size", "mean_size", "target", "tilt", (F.col("need") - F.col("full")).alias("need"), "up",
            (F.col("cut") + F.col("split") * F.col("width") / BINS).alias("cut"),
            (F.col("width") / BINS).alias("width")), "plan")
    return plan


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (key, source, size, ...) with integer ``copies`` 0 to MOST."""
    moved = (F.col("movable") & (F.col("distance") < F.col("cut"))).cast("int")
    return placed(rows, plan).withColumn(
        "copies", (F.col("base") + F.when(F.col("up"), moved).otherwise(-moved)).cast("int"))


def sized(docs: DataFrame, *keep) -> DataFrame:
    """``key, source, size`` of every document, and the columns kept."""
    return docs.select(F.xxhash64("doc_id", "source", "text").alias("key"), "source",
                       F.size(words(F.col("text"))).cast("long").alias("size"), *keep)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` of a stored table with ``rank``: 0, 1, ... among rows of equal ``key``.

    Rows are numbered inside the partitions they are read in; the counts of a key's
    earlier partitions shift the numbers, so a key of any size is spread over as many
    tasks as hold its rows.
    """
    at = rows.withColumn("part", F.spark_partition_id())
    counts = at.groupBy("key", "part").agg(F.count("*").alias("n"))
    ahead = counts.select(F.col("key").alias("of"), F.col("part").alias("in"), F.sum("n").over(
        Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead")).where("ahead > 0")
    local = at.withColumn("rank", F.row_number().over(Window.partitionBy("key", "part").orderBy("part")) - 1)
    return local.join(ahead, (F.col("key") == F.col("of")) & (F.col("part") == F.col("in")), "left").select(
        *rows.columns, (F.col("rank") + F.coalesce("ahead", F.lit(0))).alias("rank"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(numbered(stored(sized(read(spark, sf_dir, "documents"), "doc_id"), "sized")), "numbered")
    return with_copies(docs, planned(docs)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    rows = stored(numbered(stored(sized(docs), "sized")), "numbered")
    taken = stored(with_copies(rows, planned(rows, weights, share)).groupBy(F.col("key").alias("of")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")), "copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "source", "text").alias("key"))
    marked = whole.join(taken.where("copies > 0"), F.col("key") == F.col("of")).select("row", "key", "copies", "rows")
    if not taken.where("rows > 1").isEmpty():  # equal rows share their copies out
        marked = stored(marked, "marked")
        shared = numbered(marked.where("rows > 1")).select("row", F.expr(
            "copies div rows + if(rank < copies % rows, 1, 0)").alias("copies"))
        marked = marked.where("rows = 1").select("row", "copies").union(shared)
    return marked.withColumn("again", F.explode(F.sequence(F.lit(0), F.col("copies")))).where("again > 0").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
