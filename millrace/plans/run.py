"""One run of the whole join: filter, strategy, chunks, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bloom, distribute
from ..operators.join import Strategy, capped, inner_join, match_count
from .sizing import Options, filter_size, first_level, second_level


@dataclass
class Run:
    """The pairs and their exact count; what passed the filter; and the decisions that were taken."""

    pairs: DataFrame
    matches: DataFrame
    candidates: DataFrame
    shape: bloom.Shape | None
    first: int
    second: int
    strategy: Strategy
    rebalance: bool
    kept: bool = False

    def release(self) -> None:
        """Lets the candidates go that a gate has kept; what is asked for later filters S again."""
        if self.kept:
            self.candidates.unpersist()


def run(r: DataFrame, s: DataFrame, options: Options = Options()) -> Run:
    """Joins R and S, each (key, val).

    All modes, strategies and chunks give the same pairs. With several chunks S is dealt by hash, each chunk is joined by
    itself, and the pairs are united; the gate for replication then counts the first chunk only. The streaming module
    joins chunks as they come. S meets the filter once: if a gate counts what passes, that is kept for the join. Rows
    are evened out only if R is replicated, as a join by shuffling deals them anew by key anyway.
    """
    rows = r.count()
    shape = None
    bits, hashes = filter_size(rows, options.rate, options.bits, options.hashes)
    first = first_level(-(-rows // options.slices), bits, options.partitioned, options.first)
    second = second_level(-(-rows // options.slices), first, options.partitioned, options.second)
    candidates = s
    if options.mode and rows:
        shape = bloom.Shape(bits, hashes, segments=first if options.partitioned else 0)
        candidates = bloom.passing(s, bloom.build(r, shape), shape)
    strategy, rebalance, kept = Strategy.AUTO, False, False
    gated = options.replicate_ratio > 0
    if options.shuffles(first):
        strategy = Strategy.SHUFFLE_HASH
    elif options.replicate_ratio == 0:
        strategy = Strategy.REPLICATE_R
    chunk = F.pmod(F.xxhash64("key", "val"), F.lit(options.chunks))
    if options.rebalances or gated:
        # one pass over the candidates, which stay for the join, serves both decisions
        candidates, kept = candidates.persist(), True
        spread = candidates.where(chunk == 0).groupBy(F.spark_partition_id().alias("slice")).agg(F.count("*").alias("n"))
        told = distribute.skew(spread, options.skew).first()
        rebalance = options.rebalances and bool(told["rebalance"])
        if gated and rows and told["total"] * options.chunks / rows >= options.replicate_ratio:
            strategy = Strategy.REPLICATE_R
    joined = candidates
    if rebalance and strategy is Strategy.REPLICATE_R:
        joined = distribute.rebalanced(candidates, max(options.slices, r.sparkSession.sparkContext.defaultParallelism))
    parts = [joined.where(chunk == i) for i in range(options.chunks)] if options.chunks > 1 else [joined]
    pairs = inner_join(r, parts[0], strategy, rows)
    for part in parts[1:]:
        pairs = pairs.unionByName(inner_join(r, part, strategy, rows))
    if options.answer_rows is not None:
        pairs = capped(pairs, options.answer_rows)
    return Run(pairs, match_count(r, joined, strategy, rows), candidates, shape, first, second, strategy, rebalance, kept)
