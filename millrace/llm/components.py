"""Connected components of an undirected graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small


def large_star(edges: DataFrame) -> DataFrame:
    """Links all larger neighbours of each node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low", "lz4")
    return both.where("v > u").join(small(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and all its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = saved(down.groupBy("u").agg(F.min("v").alias("low")), "low", "lz4")
    rest = down.join(small(low), "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return rest.unionByName(low.withColumnRenamed("low", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v): the smallest node that it is linked to, itself for roots.

    Alternating stars: the graph halves its depth in each turn, and a node of very many links is spread over tasks, as
    minima are taken before the shuffle, and written down before they are joined, so that Spark broadcasts few of them
    and can split hot nodes of many. Every turn is written to the shared folder.
    """
    edges = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", "lz4")
    last = None
    while True:
        edges = saved(small_star(large_star(edges)), "edges", "lz4")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
