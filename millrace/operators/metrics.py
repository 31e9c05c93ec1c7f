"""A summary of timings over machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics of this name hold the whole; those of reading have no share of it.
TOTAL, READS = "Total", ("Read R", "Read S")


def summary(metrics: DataFrame, total: str = TOTAL, reads: tuple[str, ...] = READS) -> DataFrame:
    """(metric, max_seconds, max_percent, mean_seconds, mean_percent) of (pe, metric, seconds): the largest and the mean over machines, and their shares of the total's. Reads have none."""
    each = metrics.groupBy("metric").agg(F.max("seconds").alias("max_seconds"), F.avg("seconds").alias("mean_seconds"))
    whole = each.where(F.col("metric") == total)
    out = {}
    for kind in ("max", "mean"):
        all_of_it = whole.select(f"{kind}_seconds").scalar()
        share = F.when(all_of_it > 0, F.col(f"{kind}_seconds") * 100.0 / all_of_it).otherwise(0.0)
        out[f"{kind}_percent"] = F.when(~F.col("metric").isin(*reads), share)
    return each.withColumns(out).select("metric", "max_seconds", "max_percent", "mean_seconds", "mean_percent")
