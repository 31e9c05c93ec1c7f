"""Equi-joins of a build relation R and a probe relation S, each (key, val), with bag semantics: every pair counts."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: R is replicated only if its estimated size in memory is at most this many bytes; else both sides are shuffled.
REPLICATE_BYTES = 256 << 20

#: Bytes of a row of a replicated side with its place in the hash table; and, where the number of rows isn't known, how many times larger rows are than the files that they come from.
ROW_BYTES, EXPANSION = 64, 8


class Strategy(Enum):
    AUTO = "auto"
    SHUFFLE_HASH = "shuffle_hash"
    MERGE = "merge"
    REPLICATE_R = "replicate_r"
    REPLICATE_S = "replicate_s"


def relation(df: DataFrame, key: str, val: str) -> DataFrame:
    """(key, val) of a table. Keys of any integral type; null keys join nothing."""
    for name in (key, val):
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            raise TypeError(f"{name} is not integral")
    return df.select(df[key].alias("key"), df[val].alias("val"))


def as_pairs(rel: DataFrame) -> DataFrame:
    """(pair): key and value of each row, of 32 bits each, side by side in one number, the key in the upper half."""
    return rel.select(F.shiftleft(F.col("key").cast("bigint"), 32).bitwiseOR(F.col("val").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))).alias("pair"))


def from_pairs(pairs: DataFrame, keep: bool = False) -> DataFrame:
    """(key, val) of as_pairs(); with `keep`, after the pair."""
    key, val = F.shiftright("pair", 32).cast("int"), F.shiftright(F.shiftleft("pair", 32), 32).cast("int")
    return pairs.select(*["pair"] * keep, key.alias("key"), val.alias("val"))


def estimated_bytes(df: DataFrame, rows: int | None = None) -> int:
    """What a side would take in memory: by its rows, if their number is known, else by the optimizer's figure, which for a scan is of compressed files."""
    if rows is not None:
        return rows * ROW_BYTES
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) * EXPANSION


def placed(r: DataFrame, s: DataFrame, strategy: Strategy, limit: int = REPLICATE_BYTES, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two sides with the hint of a strategy; `rows` are those of R, if known. A side too large to replicate is shuffled instead."""
    if strategy is Strategy.REPLICATE_R:
        return (F.broadcast(r), s) if estimated_bytes(r, rows) <= limit else (r.hint("shuffle_hash"), s)
    if strategy is Strategy.REPLICATE_S:
        return (r, F.broadcast(s)) if estimated_bytes(s) <= limit else (r, s.hint("shuffle_hash"))
    if strategy is Strategy.SHUFFLE_HASH:
        return r.hint("shuffle_hash"), s
    if strategy is Strategy.MERGE:
        return r.hint("merge"), s
    return r, s


def inner_join(r: DataFrame, s: DataFrame, strategy: Strategy = Strategy.AUTO, rows: int | None = None) -> DataFrame:
    """(key, r_val, s_val) of every pair of equal keys."""
    r, s = placed(r.withColumnRenamed("val", "r_val"), s.withColumnRenamed("val", "s_val"), strategy, rows=rows)
    return s.join(r, "key").select("key", "r_val", "s_val")


def match_count(r: DataFrame, s: DataFrame, strategy: Strategy = Strategy.AUTO, rows: int | None = None) -> DataFrame:
    """(matches). Only keys are read and moved."""
    r, s = placed(r.select("key"), s.select("key"), strategy, rows=rows)
    return s.join(r, "key").agg(F.count("*").alias("matches"))


def first_match_join(r: DataFrame, s: DataFrame) -> DataFrame:
    """At most one pair for each row of S: the one with the least value in R."""
    return inner_join(r.groupBy("key").agg(F.min("val").alias("val")), s)


def counted_matches(r: DataFrame, s: DataFrame) -> DataFrame:
    """(matches) by multiplicities: both sides are counted by key before they meet, so a hot key is one row. An independent check of match_count."""
    left = r.where("key is not null").groupBy("key").agg(F.count("*").alias("r_rows"))
    right = s.where("key is not null").groupBy("key").agg(F.count("*").alias("s_rows"))
    return left.join(right, "key").agg(F.coalesce(F.sum(F.col("r_rows") * F.col("s_rows")), F.lit(0)).cast("bigint").alias("matches"))


def matched_rows(r: DataFrame, s: DataFrame) -> DataFrame:
    """(rows, matched, percent): rows of R whose key is in S."""
    found = membership(r, s.select("key"), "found")
    return found.agg(F.count("*").alias("rows"), F.count_if("found").alias("matched")).withColumn("percent", F.when(F.col("rows") > 0, F.col("matched") * 100.0 / F.col("rows")).otherwise(0.0))


def membership(s: DataFrame, r: DataFrame, name: str = "member") -> DataFrame:
    """s with a flag: whether its key is in r. Null keys are in none."""
    keys = r.select("key").where("key is not null").distinct().withColumn("__in", F.lit(True))
    return s.join(keys, "key", "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")


def capped(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs that an answer buffer of `most` rows takes. Count pairs without it for the exact number."""
    return pairs.limit(most)


def capped_count(pairs: DataFrame, most: int) -> DataFrame:
    """(matches, kept): the exact number of pairs, and how many a buffer of `most` rows took."""
    kept = capped(pairs, most).agg(F.count("*")).scalar()
    return pairs.agg(F.count("*").alias("matches")).withColumn("kept", kept)
