"""Two relations of which an exact number of rows match, without randomness in the values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The share of S that is its hot region, and the largest key.
HOT, LARGEST = 0.25, (1 << 31) - 1


def matches(r: int, s: int, percent: float) -> int:
    """How many rows match: the percentage of R's, but not more than S has."""
    if r < 1 or s < 1 or not 0 <= percent <= 100:
        raise ValueError("rows are at least 1, percentages 0 to 100")
    return min(int(r * percent / 100.0), s)


def regions(r: int, s: int, percent: float, most: float | None) -> tuple[int, int, int]:
    """Rows of S's hot region, and the matches inside and outside of it. Without `most` there is none."""
    k = matches(r, s, percent)
    if most is None:
        return 0, 0, k
    if not percent <= most <= 100:
        raise ValueError("the hot region's percentage is between the mean and 100")
    hot = int(s * HOT)
    inside = min(int(hot * most / 100.0), hot)
    if inside > k:
        raise ValueError(f"the hot region would need {inside} matches of {k}; at most {percent / HOT:g} percent")
    if k - inside > s - hot:
        raise ValueError("the rest does not fit outside the hot region")
    return hot, inside, k - inside


def build_relation(spark: SparkSession, r: int, s: int, percent: float) -> DataFrame:
    """(key) of R: matching keys first, then others, all distinct up to LARGEST."""
    k = matches(r, s, percent)
    i = F.col("id")
    key = F.when(i < k, i).otherwise(F.lit(k) + (i - k) % F.lit(LARGEST - k))
    return spark.range(r).select(key.cast("int").alias("key"))


def probe_relation(spark: SparkSession, r: int, s: int, percent: float, most: float | None = None, seed: int = 42) -> DataFrame:
    """(position, key) of S: as many matching keys as are to match, the rest from R's row number on. Rows are mixed by a hash of the seed inside each region, so positions hold the region and nothing else."""
    hot, inside, _ = regions(r, s, percent, most)
    k = matches(r, s, percent)
    i = F.col("id")
    rows = spark.range(s).withColumn("key", F.when(i < k, i).otherwise(F.lit(r) + (i - k) % F.lit(LARGEST - r)).cast("int"))
    # matches 0..inside-1 and the first others fill the hot region
    is_hot = F.when(i < k, i < inside).otherwise(i - k < hot - inside) if most is not None else F.lit(False)
    mixed = rows.withColumn("hot", is_hot).orderBy(F.desc("hot"), F.xxhash64("id", F.lit(seed)), "id")
    return mixed.select("hot", "key")


def file_name(relation: str, rows: int, percent: float, most: float | None = None) -> str:
    """The name under which a relation's raw file is kept."""
    return f"gen_{relation}{rows}_ans{percent:.1f}{'' if most is None else f'_max{most:.1f}'}pct.bin"
