"""S as a stream: its chunks are joined with R as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.join import Strategy, inner_join


def joined(r: DataFrame, s_stream: DataFrame, strategy: Strategy = Strategy.AUTO) -> DataFrame:
    """The stream of all pairs; R is a table, so no state is kept."""
    return inner_join(r, s_stream, strategy)


def run_chunks(r: DataFrame, s_stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each chunk's pairs to a sink, once for each chunk number, until what is there has been read. The stream's own settings bound a chunk; after a failure it goes on from the checkpoint."""

    def one(chunk: DataFrame, number: int) -> None:
        sink(inner_join(r, chunk), number)

    return s_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(pairs: DataFrame, number: int) -> DataFrame:
    """(chunk, matches) of one chunk's pairs."""
    return pairs.agg(F.count("*").alias("matches")).select(F.lit(number).cast("bigint").alias("chunk"), "matches")
