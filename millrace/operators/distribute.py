"""Which machine has how many rows, whether that is uneven, and how to even it out. All work on small tables of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import bucket


def slice_sizes(rows: DataFrame, slices: int, column: str = "slice") -> DataFrame:
    """(slice, n) of all slices, empty ones too."""
    counts = rows.groupBy(F.col(column).alias("slice")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(slices).select(F.col("id").alias("slice"))
    return every.join(F.broadcast(counts), "slice", "left").select("slice", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def skew(sizes: DataFrame, threshold: float) -> DataFrame:
    """(total, largest, imbalance, rebalance): the largest over the mean, 1 if there is nothing; whether rows should move."""
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("largest"), F.count("*").alias("slices"))
    imbalance = F.when(F.col("total") > 0, F.col("largest") / (F.col("total") / F.col("slices"))).otherwise(1.0)
    return out.withColumn("imbalance", imbalance).withColumn("rebalance", (F.col("total") > 0) & (F.col("imbalance") > threshold)).drop("slices")


def targets(sizes: DataFrame) -> DataFrame:
    """(slice, n, target): even shares; the first slices have one more if there is a remainder."""
    every = W.partitionBy()
    total, many = F.sum("n").over(every), F.count("*").over(every)
    return sizes.withColumn("target", (F.floor(total / many) + F.when(F.col("slice") < total % many, 1).otherwise(0)).cast("bigint"))


def plan(sizes: DataFrame) -> DataFrame:
    """(src, dst, n, src_first, dst_first): how many rows each slice with too many sends to each with too few, and from where to where.

    What is over and what is missing are laid along one line each, in slice order; two slices exchange as much as their
    stretches overlap.
    """
    goal = targets(sizes)
    order = W.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)

    def stretch(amount: Column, names: tuple[str, str, str]) -> DataFrame:
        some = goal.where(amount > 0).withColumn("__end", F.sum(amount).over(order)).withColumn("__begin", F.col("__end") - amount)
        return some.select(F.col("slice").alias(names[0]), F.col("__begin").alias(names[1]), F.col("__end").alias(names[2]), F.col("n").alias(f"{names[0]}_n"), F.col("target").alias(f"{names[0]}_target"))

    over = stretch(F.col("n") - F.col("target"), ("src", "a0", "a1"))
    under = stretch(F.col("target") - F.col("n"), ("dst", "b0", "b1"))
    both = over.join(F.broadcast(under), (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    start = F.greatest("a0", "b0")
    return both.select(
        "src",
        "dst",
        (F.least("a1", "b1") - start).alias("n"),
        (F.col("src_target") + start - F.col("a0")).alias("src_first"),
        (F.col("dst_n") + start - F.col("b0")).alias("dst_first"),
    )


def exchanged(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows, with their slice and their place in it, with new ones by the plan: what a slice has beyond its target goes where another lacks it. The plan has fewer rows than twice the slices."""
    moves = plan(sizes).select(F.col("src").alias("slice"), "dst", F.col("n").alias("__n"), "src_first", "dst_first")
    moved = rows.join(F.broadcast(moves), "slice", "left").where(F.col("dst").isNull() | F.col("place").between(F.col("src_first"), F.col("src_first") + F.col("__n") - 1))
    others = [c for c in rows.columns if c not in ("slice", "place")]
    away = moved.where("dst is not null").select(*others, F.col("dst").alias("slice"), (F.col("dst_first") + F.col("place") - F.col("src_first")).alias("place"))
    goal = targets(sizes).select("slice", "target")
    stay = rows.join(F.broadcast(goal), "slice").where("place < target").select(*others, "slice", "place")
    return stay.unionByName(away)


def rebalanced(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows in partitions of even size."""
    return rows.repartition(partitions)


def owner(key: Column, first: int, slices: int) -> Column:
    """The machine that owns a key's first-level bucket, when buckets are dealt in runs."""
    return F.floor(bucket(key, first) / F.lit(first // slices)).cast("bigint")


def send_matrix(rows: DataFrame, first: int, slices: int) -> DataFrame:
    """(src, dst, n, first): rows that each slice sends to each owner, and where they begin there."""
    counts = rows.where("key is not null").groupBy(F.col("slice").alias("src"), owner(F.col("key"), first, slices).alias("dst")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("dst").orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow))
    return counts.withColumn("first", before - F.col("n"))


def sent(rows: DataFrame, first: int, slices: int) -> DataFrame:
    """rows with the slice dst that owns their bucket, each owner's in one task, in the order of the slices that sent them; null keys go nowhere. Larger machines than a task holds are for Spark's joins, which need no owners."""
    own = rows.where("key is not null").withColumn("dst", owner(F.col("key"), first, slices))
    return own.repartitionByRange(slices, "dst").sortWithinPartitions("dst", "slice")


def arrivals(rows: DataFrame) -> DataFrame:
    """(dst, n, tasks, falls) of sent rows: each owner's rows, the tasks that hold them, and how often one comes before a row of an earlier slice."""
    here = rows.select("dst", "slice", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("slice").over(W.partitionBy("task", "dst").orderBy("at"))
    told = here.withColumn("falls", F.coalesce((before > F.col("slice")).cast("bigint"), F.lit(0)))
    return told.groupBy("dst").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks"), F.sum("falls").alias("falls"))


def replicate_gate(build_rows: DataFrame, candidates: DataFrame, chunks: int, ratio: float) -> DataFrame:
    """(build, candidates, expected, replicate): whether R should be sent everywhere, from the first chunk's candidates times the chunks against R's rows. A ratio of 0 always says so, one below 0 never."""
    counts = build_rows.agg(F.count("*").alias("build")).withColumn("candidates", candidates.agg(F.count("*")).scalar())
    expected = F.when(F.col("build") > 0, F.col("candidates") * F.lit(chunks) / F.col("build")).otherwise(0.0)
    return counts.withColumn("expected", expected).withColumn("replicate", F.lit(True) if ratio == 0 else (F.lit(ratio) > 0) & (F.col("expected") >= ratio))
