"""Buckets of two levels, their counts and bounds. A relation is never sorted as a whole; only counts are windowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import bucket

#: Rows that a second-level bucket's table takes.
TABLE_ROWS = 10007


def assigned(rel: DataFrame, first: int, second: int) -> DataFrame:
    """The relation with its buckets b1 and b2."""
    return rel.withColumns({"b1": bucket(F.col("key"), first), "b2": bucket(F.col("key"), second)})


def clustered(rel: DataFrame, first: int, second: int) -> DataFrame:
    """The relation dealt by its first-level buckets and sorted by both levels inside; hash partitions, so rows of a bucket stay together."""
    return assigned(rel, first, second).repartition(first, "b1").sortWithinPartitions("b1", "b2")


def order(rows: DataFrame) -> DataFrame:
    """(b1, n, tasks, falls) of a dealt relation: rows of each first-level bucket, the tasks that hold them, and how often one comes before a row of a smaller second-level bucket. Each task's rows are looked at in the order in which it has them."""
    here = rows.select("b1", "b2", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("b2").over(W.partitionBy("task", "b1").orderBy("at"))
    told = here.withColumn("falls", F.coalesce((before > F.col("b2")).cast("bigint"), F.lit(0)))
    return told.groupBy("b1").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks"), F.sum("falls").alias("falls"))


def histogram(rel: DataFrame, first: int) -> DataFrame:
    """(b1, cnt) of all first-level buckets, empty ones too."""
    rel = rel.where("key is not null")
    counts = rel.groupBy(bucket(F.col("key"), first).alias("b1")).agg(F.count("*").alias("cnt"))
    every = rel.sparkSession.range(first).select(F.col("id").alias("b1"))
    return every.join(F.broadcast(counts), "b1", "left").select("b1", F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt"))


def index(counts: DataFrame, order: str, *within: str) -> DataFrame:
    """Counts with the inclusive bound and the exclusive offset of each bucket, in its own group."""
    total = F.sum("cnt").over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return counts.withColumns({"bound": total, "first": total - F.col("cnt")})


def level1_index(rel: DataFrame, first: int) -> DataFrame:
    """(b1, cnt, bound, first); a row for each bucket."""
    return index(histogram(rel, first), "b1")


def level2_counts(rel: DataFrame, first: int, second: int) -> DataFrame:
    """(b1, b2, cnt) of the buckets of both levels that have rows."""
    return assigned(rel.where("key is not null"), first, second).groupBy("b1", "b2").agg(F.count("*").alias("cnt"))


def level2_index(rel: DataFrame, first: int, second: int) -> DataFrame:
    """(b1, b2, cnt, bound, first); bounds begin anew in each first-level bucket."""
    return index(level2_counts(rel, first, second), "b2", "b1")


def overflows(rel: DataFrame, first: int, second: int, rows: int = TABLE_ROWS) -> DataFrame:
    """(overflows, largest): second-level buckets of at least `rows` rows, and the most in one. They need no other treatment here; Spark's joins spill."""
    return level2_counts(rel, first, second).agg(F.count_if(F.col("cnt") >= rows).alias("overflows"), F.coalesce(F.max("cnt"), F.lit(0).cast("bigint")).alias("largest"))
